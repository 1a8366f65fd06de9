"""Routing by tables of rules of any size: an index by each rule's rarest part.

A rule has a pattern for each of some columns and fits a row if all its patterns fit.
Rules and rows meet where a row holds one of the rule's literal parts, cut to GRAM
characters: of all such grams of a rule, in any of its columns, the one that the fewest
rows hold. Grams are told apart by hashes, since whoever meets is tested in full anyway. A rule of
which no row holds some gram fits nothing and meets nobody. So rules
that begin alike don't meet all rows that begin so, and a table with a catch-all pattern
in one column is met by the other one. Each key is dealt to SALT partitions. Of rules with
the same pattern only the first one is matched.

Rules without any literal character fit by length or by classes of characters. Of those
without classes, only the first one for each length counts; the rest is broadcast in
parts of PART rules, as many parts as there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import cut
from . import rules as R

GRAM, SALT, PART = 3, 16, 500
#: Bits of a gram's key, its size above its hash; a count stands above them when the rarest is chosen, so that no aggregate holds more than a number.
KEY, HASH = 40, 38
CLASS = r"\[[^\]]+\]"


def _grams(x: Column, size: int) -> Column:
    """The distinct stretches of `size` characters of a text."""
    at = F.sequence(F.lit(1), F.length(x) - size + 1)
    return F.when(F.length(x) >= size, F.array_distinct(F.transform(at, lambda k: F.substring(x, k, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def _key(gram: Column, column: int) -> Column:
    """A number for a gram of a column, with its size in the two bits above its hash."""
    return F.shiftleft(F.length(gram).cast("long"), HASH).bitwiseOR(F.xxhash64(F.lit(column), gram).bitwiseAND(F.lit((1 << HASH) - 1)))


def _keys_of_rule(pattern: Column, column: int) -> Column:
    """The keys of the grams of a pattern's literal parts, the whole part where it is shorter."""
    parts = F.filter(F.split(F.regexp_replace(pattern, rf"{CLASS}|[*?]", "\x00"), "\x00"), lambda p: p != "")
    grams = F.flatten(F.transform(parts, lambda p: F.when(F.length(p) >= GRAM, _grams(p, GRAM)).otherwise(F.array(p))))
    return F.array_distinct(F.transform(grams, lambda g: _key(g, column)))


def _keys_of_row(text: Column, column: int, sizes: list[int]) -> Column:
    return F.transform(F.flatten(F.array(*(_grams(text, n) for n in sizes))), lambda g: _key(g, column))


def _fits(text: Column, pattern: Column, regex: Column) -> Column:
    """As rules.matches, for patterns in a column; plain parts need no expression."""
    return F.when(pattern.rlike(r"[*?\[]"), F.rlike(text, regex)).otherwise(text.contains(pattern))


def _prepared(rules: DataFrame, patterns: list[str]) -> DataFrame:
    """rules with normalised patterns p0.. and the keys of all literal parts; those with an empty pattern fit nothing."""
    kept = [c for c in rules.columns if c not in patterns]
    normal = rules.select(*kept, *(T.match_text(F.col(p)).alias(f"_p{k}") for k, p in enumerate(patterns)))
    for k in range(len(patterns)):
        normal = normal.where(F.col(f"_p{k}") != "")
    return normal.withColumn("_keys", F.flatten(F.array(*(_keys_of_rule(F.col(f"_p{k}"), k) for k in range(len(patterns))))))


def _expressed(rules: DataFrame) -> DataFrame:
    """Prepared rules with the expressions r0.. of their patterns: for those that meet anybody."""
    count = len([c for c in rules.columns if c.startswith("_p")])
    return rules.select("*", *(R._as_regex(f"_p{k}").alias(f"_r{k}") for k in range(count)))


def candidates(rows: DataFrame, prepared: DataFrame, texts: list[str]) -> DataFrame:
    """Rows (texts as `texts`, normalised) beside the rules with literal parts that may fit them: those whose rarest key they hold."""
    keyed = prepared.where(F.size("_keys") > 0)
    sizes = sorted(r["n"] for r in keyed.select(F.explode(F.transform("_keys", lambda k: F.shiftright(k, HASH))).alias("n")).distinct().collect()) or [GRAM]  # GRAM values at most
    wanted = keyed.select(F.explode("_keys").alias("_key")).distinct()
    own = F.array_distinct(F.flatten(F.array(*(_keys_of_row(F.col(t), k, sizes) for k, t in enumerate(texts)))))
    held = rows.withColumn("_key", F.explode(own)).join(wanted, "_key", "left_semi")
    often = held.groupBy("_key").agg(F.count("*").alias("_n"))
    # by its content: the rarest key of each rule, none where no row holds one of them
    same = [c for c in prepared.columns if c != "_keys"]
    count = F.least(F.coalesce("_n", F.lit(0)), F.lit((1 << 63 - KEY) - 1))
    rarest = keyed.select(*same, F.explode("_keys").alias("_key")).join(often, "_key", "left").groupBy(*same).agg(F.min(F.shiftleft(count, KEY).bitwiseOR(F.col("_key"))).alias("_best"))
    chosen = _expressed(rarest.where(F.col("_best") >= 1 << KEY)).withColumn("_key", F.col("_best").bitwiseAND(F.lit((1 << KEY) - 1))).drop("_best").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    met = held.join(chosen.select("_key").distinct(), "_key", "left_semi").withColumn("_salt", F.pmod(F.xxhash64(*texts), F.lit(SALT)).cast("int"))
    return met.join(chosen, ["_key", "_salt"]).drop("_key", "_salt")


def _loose(prepared: DataFrame, kind: str | None) -> DataFrame:
    """Rules without literal characters; of those that fit by length alone only the first of each, by what may decide: priority and value."""
    count = len([c for c in prepared.columns if c.startswith("_p")])
    bare = prepared.where(F.size("_keys") == 0).drop("_keys")
    by_length = F.struct(*(F.struct(F.length(F.replace(F.col(f"_p{k}"), F.lit("*"), F.lit(""))).alias("least"), F.col(f"_p{k}").contains("*").alias("more")) for k in range(count)))
    shape = F.when(~F.concat(*(F.col(f"_p{k}") for k in range(count))).contains("["), F.to_json(by_length)).otherwise(F.concat_ws("\x00", *(f"_p{k}" for k in range(count))))
    first = bare.withColumn("_shape", shape).groupBy("_shape", *([kind] if kind else [])).agg(F.min_by(F.struct(*bare.columns), F.struct("priority", "value")).alias("_rule"))
    return first.select("_rule.*")


def fitting(rows: DataFrame, rules: DataFrame, patterns: dict[str, str], kind: str | None = None) -> DataFrame:
    """The distinct rows of the columns that `patterns` names, beside the rules (priority, value, a pattern for each column) that fit them.

    Of rules that fit by the lengths of texts alone only the first ones (of each `kind`) are listed, as no others can decide.
    """
    columns = list(patterns)
    texts = [f"_t{k}" for k in range(len(columns))]
    each = rows.select(*columns).dropna().distinct().select(*columns, *(T.match_text(F.col(c)).alias(t) for c, t in zip(columns, texts, strict=True)))
    prepared = cut(_prepared(rules, list(patterns.values())))
    test = F.lit(True)
    for k, t in enumerate(texts):
        test = test & _fits(F.col(t), F.col(f"_p{k}"), F.col(f"_r{k}"))
    out = [*columns, "priority", "value", *([kind] if kind else [])]
    found = candidates(each, prepared, texts).where(test).select(*out)
    loose = cut(_expressed(_loose(prepared, kind)))
    parts = -(-loose.count() // PART)
    for part in range(parts):
        own = loose.where(F.pmod(F.xxhash64(*(f"_p{k}" for k in range(len(columns)))), F.lit(parts)) == part)
        found = found.unionByName(each.join(F.broadcast(own), test).select(*out))
    return found


def first_of_alike(rules: DataFrame) -> DataFrame:
    """Of rules (priority, pattern, value) with the same pattern the first one, as no other can decide.

    Dealt by whole rules before, so that those alike aren't one task's; cut, so that what is asked
    of patterns later isn't asked of each rule.
    """
    dealt = rules.select("priority", "pattern", "value").repartition("priority", "pattern", "value")
    return cut(dealt.groupBy("pattern").agg(F.min(F.struct("priority", "value")).alias("_first")).select("pattern", "_first.*"))


def match_table(names: DataFrame, rules: DataFrame, name: str) -> DataFrame:
    """names with rule_priority and value of the first fitting rule of a table (priority, pattern, value); null where none fits.

    Of equal priorities the smaller value counts. Names are matched once each; null names fit nothing.
    """
    best = fitting(names, first_of_alike(rules), {name: "pattern"}).groupBy(name).agg(F.min(F.struct("priority", "value")).alias("best"))
    return names.join(best, name, "left").select(names["*"], F.col("best.priority").alias("rule_priority"), F.col("best.value").alias("value"))


def split_destinations(rules: DataFrame) -> DataFrame:
    """(priority, course_pattern, section_pattern, sheet_only, value) of rules (priority, pattern, value) as rules.destination has them; others are left out."""
    key, behind = T.strip(F.col("pattern")), F.lit("/" + T.SHEET_PLACEHOLDER)
    sheet = F.endswith(F.lower(key), behind)
    bare = T.strip(F.when(sheet, F.left(key, F.length(key) - F.length(behind))).otherwise(key))
    tail = F.substring_index(bare, "/", -1)
    head = F.left(bare, F.length(bare) - F.length(tail) - 1)
    return rules.select("priority", T.strip(head).alias("course_pattern"), T.strip(tail).alias("section_pattern"), sheet.alias("sheet_only"), "value").where(bare.contains("/") & (head != "") & (tail != ""))


def destination_table(files: DataFrame, rules: DataFrame, course: str, section: str, file: str) -> DataFrame:
    """files with `destination` by a table of rules (priority, pattern, value), as rules.destination gives it; null where none fits.

    Pairs of a course and a section are matched once each, then the files get the pair's first
    rule for numbered sheets and its first other one.
    """
    best = lambda only: F.min(F.when(F.col("sheet_only") == F.lit(only), F.struct("priority", "value")))["value"]
    pairs = fitting(files, split_destinations(first_of_alike(rules)), {course: "course_pattern", section: "section_pattern"}, "sheet_only")
    pairs = pairs.groupBy(course, section).agg(best(True).alias("_sheet"), best(False).alias("_plain"))
    number = T.sheet_number(F.col(file))
    joined = files.join(pairs, [course, section], "left")
    return joined.select(files["*"], F.coalesce(F.when(number.isNotNull() & F.col("_sheet").isNotNull(), T.fill_sheet(F.col("_sheet"), number)), F.col("_plain")).alias("destination"))


TABLE_RULES = ["standard ?*", "ROMO", "*c?nomy", "s*all", "[lm][ae]*", "ing", "*ndard"]


def rule_table_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each type of part with the first rule of a table of rules, as many as there are customers, that fits."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_type")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_mktsegment")
    shape = F.get(F.array(*map(F.lit, TABLE_RULES)), (F.col("c_custkey") % len(TABLE_RULES)).cast("int"))
    made = c.where("c_custkey > 0").select(F.col("c_custkey").alias("priority"), F.when(F.col("c_custkey") % 11 == 0, shape).otherwise(F.concat(F.lower("c_mktsegment"), F.lit("*"), "c_custkey")).alias("pattern"), F.concat(F.lit("rule "), "c_custkey").alias("value"))
    return match_table(parts, made, "p_type").select("p_partkey", F.col("rule_priority").alias("priority"), "value")


#: Patterns of courses and sections by the remainder of a part's number; {c} is the first word of its name, {s} its brand.
SHAPES = [("{c}*", "{s}"), ("*", "?rand[#]*{k}"), ("*{c}?*", "*"), ("{c} {k}", "*{s}"), ("??*", "*#[{k}x]")]


def table_destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's destination by a table of rules, one for each part: names are courses, brands sections."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_brand")
    key = F.col("p_partkey")
    shape = F.get(F.array(*(F.lit(f"{c}/{s}") for c, s in SHAPES)), (key % len(SHAPES)).cast("int"))
    filled = F.replace(F.replace(F.replace(shape, F.lit("{c}"), F.substring_index("p_name", " ", 1)), F.lit("{s}"), F.upper("p_brand")), F.lit("{k}"), (key % 10).cast("string"))
    rules = parts.select((key * 7919 % 10007).alias("priority"), F.concat(filled, F.when(key % 4 == 0, "/{Blatt}").otherwise("")).alias("pattern"), F.concat(F.lit("d"), key, F.when(key % 4 == 0, "/{blatt}").otherwise("")).alias("value"))
    files = parts.withColumn("file", F.concat(F.when(key % 3 == 0, "Blatt_").otherwise("notes"), (key % 40).cast("string"), F.lit(".pdf")))
    return destination_table(files, rules, "p_name", "p_brand", "file").select("p_partkey", "destination")


QUERIES = {f.__name__: f for f in (rule_table_match, table_destinations)}
_SHAPE = lambda k: "replace(replace(replace((" + str([s[k] for s in SHAPES]) + f")[p_partkey % {len(SHAPES)} + 1], '{{c}}', split_part(p_name, ' ', 1)), '{{s}}', lower(p_brand)), '{{k}}', (p_partkey % 10)::VARCHAR)"
_LIKE = lambda text, pattern: f"CASE WHEN regexp_matches({pattern}, '[*?]') THEN regexp_full_match(lower({text}), replace(replace({pattern}, '?', '.'), '*', '.*')) ELSE contains(lower({text}), {pattern}) END"
ORACLES = {
    "rule_table_match": f"""
        WITH r AS (SELECT c_custkey AS priority, ({["^standard ..*$", "romo", "^.*c.nomy$", "^s.*all$", "^[lm][ae].*$", "ing", "^.*ndard$"]})[c_custkey % {len(TABLE_RULES)} + 1] AS regex FROM customer WHERE c_custkey % 11 = 0 AND c_custkey > 0)
        SELECT p_partkey, min(priority) AS priority, 'rule ' || min(priority) AS value FROM part LEFT JOIN r ON regexp_matches(lower(p_type), regex) GROUP BY p_partkey""",
    "table_destinations": f"""
        WITH rules AS (SELECT p_partkey * 7919 % 10007 AS priority, {_SHAPE(0)} AS c, {_SHAPE(1)} AS s, p_partkey % 4 = 0 AS sheet, 'd' || p_partkey AS value FROM part),
        firsts AS (SELECT c, s, sheet, min((priority, value)) AS best FROM rules GROUP BY ALL),
        pairs AS (SELECT DISTINCT p_name, p_brand FROM part),
        hit AS (SELECT p_name, p_brand, sheet, min(best)[2] AS value FROM pairs, firsts WHERE {_LIKE("p_name", "c")} AND {_LIKE("p_brand", "s")} GROUP BY ALL)
        SELECT p_partkey, coalesce(CASE WHEN p_partkey % 3 = 0 THEN a.value || '/Blatt' || lpad((p_partkey % 40)::VARCHAR, 2, '0') END, b.value) AS destination
        FROM part LEFT JOIN hit a ON a.p_name = part.p_name AND a.p_brand = part.p_brand AND a.sheet LEFT JOIN hit b ON b.p_name = part.p_name AND b.p_brand = part.p_brand AND NOT b.sheet""",
}
