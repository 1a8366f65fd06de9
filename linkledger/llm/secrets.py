"""Secret scans: fixed patterns, and Shannon entropy in a sliding window over candidate strings.

Everything is made of DataFrame functions. A pattern's places are running sums over the
lengths of what it matches and of what lies between. A candidate is a run of WINDOW or more
characters that keys are written in. Its windows are read one character after the other:
a window's entropy follows from the last one's by the counts of the character that leaves
and of the one that enters, and its character class from how long ago a character outside
each class was read. A window is hot if it has the bits that its class asks for; hot
windows that touch are a span of kind `entropy`, unless a span of a pattern overlaps, or
the span is short and it or what is next to it is on the allow-list. Class and allow-list
are judged by the window and the span, never by the whole candidate, so a name before a
key or a word in a long run of base64 hides nothing else.

Time grows in proportion to the text, however long one candidate is and however many
matches a text has: sums run in blocks of BLOCK, candidates are read in chunks of CHUNK
characters, and spans of both kinds meet in one sorted array.

Defined cases: a null or empty text has no span: zeros, an empty list and its hash; an
empty table gives an empty result; repeated rows get equal results; very long texts are
whole; `scan` passes all columns on, whatever their names, and the query reads no others.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _spark as S

#: Kinds in the order in which spans with equal starts are listed.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Characters in a window.
WINDOW = 20
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
#: Bits a character that a window needs if it holds just hex digits, capitals and digits, letters and digits, or others too.
BITS = (2.75, 3.4, 3.6, 3.8)
#: What spans of up to SHORT characters are suppressed for, if they or WINDOW characters on either side hold it: placeholders.
ALLOWED = r"(?i)example|sample|placeholder|change_?me|dummy|redacted|lorem|your[_-]|x{5}|0{6}|1234567|abcdefg"
SHORT = 80
#: Terms of a sum in a block, and characters of a candidate in a chunk.
BLOCK, CHUNK = 256, 1024
#: c * log2(c) in millionths for counts from 0; integers, so that sums don't depend on their order.
TERMS = [0, *(round(1e6 * c * math.log2(c)) for c in range(1, WINDOW + 1))]
MOST = [round(1e6 * WINDOW * (math.log2(WINDOW) - bits)) for bits in BITS]
SPAN = "array<struct<start:int,kind:int,end:int>>"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def running(values: Column, first: int, add: Callable[[Column, Column], Column]) -> Column:
    """For each of an array of integers, what `add` makes of `first` and all values before it."""

    def within(block: Column, start: Column) -> Column:
        begin = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(block, begin, lambda s, v: F.struct(add(s["at"], v).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])

    def of(whole: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(whole) - 1) / BLOCK).cast("int")), lambda b: F.slice(whole, b * BLOCK + 1, F.lit(BLOCK)))
        blocks = lambda all_: F.flatten(F.zip_with(all_, within(F.transform(all_, lambda b: F.aggregate(b, F.lit(first), add)), F.lit(first)), within))
        return F.when(F.size(whole) <= BLOCK, within(whole, F.lit(first))).otherwise(let(cut, blocks))

    return let(values, of)


def places(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """array<struct<start, kind, end, value>> of the pattern's matches whose group has `least` characters."""
    gaps = F.transform(F.split(text, pattern, -1), F.length)  # one more than matches: what follows the last one
    pieces = F.zip_with(gaps, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda g, m: F.struct(g.alias("gap"), m.alias("value")))
    if group:
        kept = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda x: F.length(x) >= least)
        pieces = F.zip_with(pieces, kept, lambda p, k: F.struct(p["gap"].alias("gap"), p["value"].alias("value"), F.coalesce(k, F.lit(False)).alias("kept")))
    else:
        pieces = F.transform(pieces, lambda p: F.struct(p["gap"].alias("gap"), p["value"].alias("value"), p["value"].isNotNull().alias("kept")))

    def spans(pieces: Column) -> Column:
        lengths = F.transform(pieces, lambda p: p["gap"] + F.coalesce(F.length(p["value"]), F.lit(0)))
        at = lambda p, before: F.struct(p["kept"].alias("kept"), (before + p["gap"]).alias("start"), F.lit(kind).alias("kind"), (before + p["gap"] + F.length(p["value"])).alias("end"), p["value"].alias("value"))
        placed = F.filter(F.zip_with(pieces, running(lengths, 0, lambda x, y: x + y), at), lambda s: s["kept"])
        return F.transform(placed, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value")))

    return F.when(text.rlike(pattern), let(pieces, spans)).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>"))


def touching(spans: Column) -> Column:
    """Sorted spans (start, end), those that overlap or touch as one."""

    def merged(all_: Column) -> Column:
        heads = F.filter(all_, lambda s, i: (i == 0) | (F.get(all_, i - 1)["end"] < s["start"]))
        tails = F.filter(all_, lambda s, i: (i == F.size(all_) - 1) | (F.get(all_, i + 1)["start"] > s["end"]))
        return F.zip_with(heads, tails, lambda a, b: F.struct(a["start"].alias("start"), b["end"].alias("end")))

    return let(spans, merged)


def hot_windows(before: Column, chunk: Column, offset: Column) -> Column:
    """array<struct<start, end>> of a chunk's hot windows, touching ones as one; `before` are the characters ahead of it, WINDOW - 1 at most."""
    terms = F.array(*map(F.lit, TERMS))
    count = lambda window, char: F.length(window) - F.length(F.replace(window, char, F.lit("")))

    def step(s: Column, char: Column) -> Column:
        full = F.length(s["window"]) == WINDOW
        digit, lower, upper = (char.between(a, b) for a, b in ("09", "az", "AZ"))
        first = F.struct(F.left(s["window"], F.lit(1)).alias("out"), F.when(full, F.right(s["window"], F.lit(WINDOW - 1))).otherwise(s["window"]).alias("rest"), digit.alias("digit"), lower.alias("lower"), upper.alias("upper"))
        return let(first, lambda c: let(F.when(full, count(s["window"], c["out"])).otherwise(0), lambda gone: let(count(c["rest"], char), lambda same: counted(s, char, c, gone, same))))

    def counted(s: Column, char: Column, c: Column, gone: Column, same: Column) -> Column:
        total = s["total"] - F.when(gone > 0, F.get(terms, gone) - F.get(terms, gone - 1)).otherwise(0) + F.get(terms, same + 1) - F.get(terms, same)
        # how many characters ago one of each class was read
        hexed = c["digit"] | char.between("a", "f") | char.between("A", "F")
        ago = {"digit": c["digit"], "lower": c["lower"], "upper": c["upper"], "beyond": ~hexed, "sign": ~(c["digit"] | c["lower"] | c["upper"])}
        now = F.struct((s["read"] + 1).alias("read"), total.alias("total"), *(F.when(is_, 0).otherwise(s[name] + 1).alias(name) for name, is_ in ago.items()))
        return let(now, lambda n: let(hot(n), lambda is_hot: let(is_hot & (s["end"] < offset + n["read"] - WINDOW), lambda new: added(s, F.concat(c["rest"], char), n, is_hot, new))))

    def hot(n: Column) -> Column:
        has = {name: n[name] < WINDOW for name in ("digit", "lower", "upper", "beyond", "sign")}
        most = (
            F.when(~has["digit"] | ~(has["lower"] | has["upper"]), -1)
            .when(~has["beyond"], MOST[0])
            .when(~has["lower"] & ~has["sign"], MOST[1])
            .when(~has["sign"], MOST[2])
            .when(has["lower"] & has["upper"], MOST[3])
            .otherwise(-1)
        )
        return (n["read"] >= WINDOW) & (n["total"] <= MOST[0]) & (n["total"] <= most)

    def added(s: Column, window: Column, n: Column, is_hot: Column, new: Column) -> Column:
        end = offset + n["read"]
        return F.struct(
            window.alias("window"),
            *(n[name].alias(name) for name in ("total", "read", "digit", "lower", "upper", "beyond", "sign")),
            F.when(new, end - WINDOW).otherwise(s["start"]).alias("start"),
            F.when(is_hot, end).otherwise(s["end"]).alias("end"),
            F.when(new & (s["end"] >= 0), F.concat(s["spans"], F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))).otherwise(s["spans"]).alias("spans"),
        )

    never = F.lit(WINDOW)
    begin = F.struct(F.lit("").alias("window"), F.lit(0).alias("total"), F.lit(0).alias("read"), *(never.alias(n) for n in ("digit", "lower", "upper", "beyond", "sign")), F.lit(-1).alias("start"), F.lit(-1).alias("end"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    last = lambda s: F.when(s["end"] >= 0, F.concat(s["spans"], F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))).otherwise(s["spans"])
    return F.aggregate(F.split(F.concat(before, chunk), ""), begin, step, last)


def hot_spans(value: Column) -> Column:
    """array<struct<start, end>> of a candidate's hot windows, touching ones as one, without what the allow-list has."""

    def of(chunks: Column) -> Column:
        tail = lambda i: F.when(i > 0, F.right(F.get(chunks, i - 1), F.lit(WINDOW - 1))).otherwise("")
        each = F.transform(chunks, lambda c, i: hot_windows(tail(i), c, i * CHUNK - F.length(tail(i))))

        def allowed(s: Column) -> Column:
            k = F.floor(s["start"] / CHUNK).cast("int")
            around = F.concat(*(F.coalesce(F.get(chunks, F.when(k + d >= 0, k + d)), F.lit("")) for d in (-1, 0, 1)))
            begin = s["start"] - F.greatest(k - 1, F.lit(0)) * CHUNK
            first = F.greatest(begin - WINDOW, F.lit(0))
            return (s["end"] - s["start"] <= SHORT) & F.substring(around, first + 1, begin - first + s["end"] - s["start"] + WINDOW).rlike(ALLOWED)

        return F.filter(touching(F.flatten(each)), lambda s: ~allowed(s))

    return let(F.regexp_extract_all(value, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)), of)


def entropy_spans(text: Column) -> Column:
    """Spans of kind `entropy`, whatever else lies there."""
    hot = F.transform(places(text, CANDIDATE, 4), lambda c: F.transform(hot_spans(c["value"]), lambda s: F.struct((c["start"] + s["start"]).alias("start"), F.lit(4).alias("kind"), (c["start"] + s["end"]).alias("end"))))
    return F.when(text.rlike(CANDIDATE), F.flatten(hot)).otherwise(F.array().cast(SPAN))


def apart(spans: Column) -> Column:
    """Of sorted spans, those of kind `entropy` that overlap no other kind: none before reaches into them, none after begins in them."""
    far = (1 << 31) - 1

    def of(all_: Column) -> Column:
        other = lambda s: s["kind"] < 4
        reach = running(F.transform(all_, lambda s: F.when(other(s), s["end"]).otherwise(0)), 0, lambda x, y: F.greatest(x, y))
        next_ = F.reverse(running(F.reverse(F.transform(all_, lambda s: F.when(other(s), s["start"]).otherwise(far))), far, lambda x, y: F.least(x, y)))
        free = F.zip_with(all_, F.arrays_zip(reach.alias("reach"), next_.alias("next")), lambda s, n: F.struct((~other(s) & (n["reach"] <= s["start"]) & (n["next"] >= s["end"])).alias("free"), s.alias("span")))
        return F.transform(F.filter(free, lambda f: f["free"]), lambda f: f["span"])

    return let(spans, of)


def scan(docs: DataFrame, result: str, text: str = "text") -> DataFrame:
    """docs with `result`: struct<base, added>, both array<struct<start, kind, end>> by start, then kind."""
    body = F.coalesce(F.col(text), F.lit(""))
    short = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    base = F.array_sort(short(F.concat(places(body, ASSIGN, 1, 2, 6), places(body, ACCESS, 2), places(body, HEX, 3))))
    both = lambda b: let(entropy_spans(body), lambda m: F.struct(b.alias("base"), F.when(F.size(m) > 0, apart(F.array_sort(F.concat(b, m)))).otherwise(m).alias("added")))
    return docs.withColumn(result, let(base, both))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_secrets(spark, sf_dir: str) -> DataFrame:
    """Every document's secrets: counts of the three patterns, the digest of their spans, and all spans."""
    found = scan(S.table(spark, sf_dir, "documents").select("doc_id", "text"), "found")
    n = lambda kind: F.size(F.filter("found.base", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", n(1).alias("n_assign"), n(2).alias("n_access"), n(3).alias("n_hex"), F.sha2(joined(F.col("found.base")), 256).alias("base_sha256"), joined(F.array_sort(F.concat("found.base", "found.added"))).alias("spans"))


def _sql_places(pattern: str, kind: int, test: str = "true") -> str:
    raw = pattern.replace("'", "''")
    return f"""
        SELECT doc_id, text, {kind} AS kind, m, g2, s, s + length(m) AS e FROM (
            SELECT doc_id, text, unnest(ms) AS m, unnest(g2s) AS g2,
                   unnest(list_transform(range(1, len(ms) + 1), lambda k: list_sum(list_transform(gaps[1:k], lambda g: length(g)))::BIGINT + coalesce(list_sum(list_transform(ms[1:k - 1], lambda g: length(g))), 0)::BIGINT)) AS s
            FROM (SELECT doc_id, text, regexp_extract_all(text, '{raw}', 0) AS ms, regexp_extract_all(text, '{raw}', {2 if kind == 1 else 0}) AS g2s, string_split_regex(text, '{raw}') AS gaps FROM docs) WHERE len(ms) > 0)
        WHERE {test}"""


_HAS = lambda chars: f"regexp_matches(w, '[{chars}]')"
_MOST = f"""CASE WHEN NOT {_HAS("0-9")} OR NOT {_HAS("A-Za-z")} THEN -1 WHEN NOT {_HAS("^0-9a-fA-F")} THEN {MOST[0]} WHEN NOT {_HAS("^0-9A-Z")} THEN {MOST[1]}
    WHEN NOT {_HAS("^0-9A-Za-z")} THEN {MOST[2]} WHEN {_HAS("a-z")} AND {_HAS("A-Z")} THEN {MOST[3]} ELSE -1 END"""
ORACLE = f"""
    WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    base AS ({_sql_places(ASSIGN, 1, "length(g2) >= 6")} UNION ALL {_sql_places(ACCESS, 2)} UNION ALL {_sql_places(HEX, 3)}),
    windows AS (SELECT doc_id, s, m, i, substr(m, i::INT + 1, {WINDOW}) AS w FROM (SELECT doc_id, s, m, unnest(range(0, length(m) - {WINDOW} + 1)) AS i FROM ({_sql_places(CANDIDATE, 4)}))),
    hot AS (SELECT doc_id, s, m, i FROM windows WHERE list_sum(list_transform(list_distinct(string_split(w, '')), lambda c: ({TERMS})[{WINDOW} - length(replace(w, c, '')) + 1])) <= {_MOST}),
    islands AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, s ORDER BY i) AS island FROM (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id, s ORDER BY i) <= {WINDOW} THEN 0 ELSE 1 END AS new FROM hot)),
    parts AS (SELECT doc_id, s, any_value(m) AS m, min(i)::INT AS a, (max(i) + {WINDOW})::INT AS b FROM islands GROUP BY doc_id, s, island),
    added AS (SELECT doc_id, s + a AS s, s + b AS e FROM parts WHERE NOT (b - a <= {SHORT} AND regexp_matches(substr(m, greatest(a - {WINDOW}, 0) + 1, b + {WINDOW} - greatest(a - {WINDOW}, 0)), '{ALLOWED}'))),
    spans AS (SELECT doc_id, kind, s, e FROM base UNION ALL SELECT doc_id, 4, s, e FROM added a WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = a.doc_id AND b.s < a.e AND a.s < b.e))
    SELECT d.doc_id, count(*) FILTER (kind = 1) AS n_assign, count(*) FILTER (kind = 2) AS n_access, count(*) FILTER (kind = 3) AS n_hex,
           sha256(coalesce(string_agg(['assign', 'access', 'hex', 'entropy'][kind] || ':' || s || ':' || e, ',' ORDER BY s, kind, e) FILTER (kind < 4), '')) AS base_sha256,
           coalesce(string_agg(['assign', 'access', 'hex', 'entropy'][kind] || ':' || s || ':' || e, ',' ORDER BY s, kind, e) FILTER (kind IS NOT NULL), '') AS spans
    FROM docs d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id"""
ORACLES = {"op7_secrets": ORACLE}
