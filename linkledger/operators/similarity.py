"""Fuzzy scores of folder names against course titles, and which folder goes to which course."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

#: Least score, lead over those outside the band, width of the band, days that make a folder newer.
LEAST, LEAD, BAND, NEWER_DAYS = 0.75, 0.08, 0.10, 14


def common_prefix(a: Column, b: Column) -> Column:
    """How many first characters two texts share."""
    upto = F.sequence(F.lit(0), F.least(F.length(a), F.length(b)))
    return F.array_max(F.filter(upto, lambda n: F.left(a, n) == F.left(b, n)))


def _pair_score(segment: Column, token: Column) -> Column:
    shared = common_prefix(segment, token)
    n = F.length(segment)
    return (
        F.when(segment == token, 1.0)
        .when((n >= 2) & token.startswith(segment), 0.9)
        .when((F.length(token) >= 3) & segment.startswith(token), 0.8)
        .when((shared >= 3) & (shared >= n - 1), 0.75)
        .when((n >= 4) & token.contains(segment), 0.7)
        .otherwise(0.0)
    )


def segment_score(segments: Column, tokens: Column) -> Column:
    """The best scores of the segments that aren't numbers, averaged by their lengths."""
    named = F.filter(segments, lambda s: ~T.is_numeric(s))
    weights = F.aggregate(named, F.lit(0), lambda acc, s: acc + F.length(s))
    total = F.aggregate(named, F.lit(0.0), lambda acc, s: acc + F.length(s) * F.array_max(F.transform(tokens, lambda t: _pair_score(s, t))))
    return F.coalesce(F.try_divide(total, weights), F.lit(0.0))


def initials(words: Column) -> Column:
    return F.array_join(F.transform(F.filter(words, lambda w: ~T.is_numeric(w)), lambda w: F.left(w, F.lit(1))), "")


def acronym_score(segments: Column, tokens: Column) -> Column:
    """Where the folder's initials are a word of the title, or the folder is the title's initials."""
    own, one = initials(segments), F.get(segments, F.lit(0))
    whole = (F.size(segments) == 1) & (F.length(one) >= 2) & (one == initials(tokens))
    return F.when((F.length(own) >= 2) & F.array_contains(tokens, own), 0.9).when(whole, 0.85).otherwise(0.0)


def compound_score(segments: Column, tokens: Column) -> Column:
    """Where two segments or more stand in one word of the title in their order, from its start, with four characters or more."""
    named = F.filter(segments, lambda s: ~T.is_numeric(s))

    def holds(token: Column) -> Column:
        def step(at: Column, s: Column) -> Column:
            found = F.call_function("locate", s, token, F.greatest(at, F.lit(1)))
            return F.when(at <= 0, 0).when((found == 0) | ((at == 1) & (found != 1)), 0).otherwise(found + F.length(s))

        return F.aggregate(named, F.lit(1), step) > 1

    fits = (F.size(named) >= 2) & (F.aggregate(named, F.lit(0), lambda acc, s: acc + F.length(s)) >= 4) & F.exists(tokens, holds)
    return F.when(fits, 0.9).otherwise(0.0)


def score(course: Column, folder: Column) -> Column:
    """How well a folder's name fits a course's title, from 0 to 1."""
    tokens, segments = T.course_tokens(course), T.words(folder)
    best = F.greatest(segment_score(segments, tokens), acronym_score(segments, tokens), compound_score(segments, tokens))
    return F.when((F.size(tokens) == 0) | (F.size(segments) == 0), 0.0).otherwise(best)


def _of_lengths(word: Column, sizes: list[int], mark: str) -> Column:
    """All stretches of a word of the given lengths, marked."""
    each = lambda n: F.when(F.length(word) >= n, F.transform(F.sequence(F.lit(1), F.length(word) - n + 1), lambda k: F.concat(F.lit(f"{mark}{n}:"), F.substring(word, k, F.lit(n))))).otherwise(F.array().cast("array<string>"))
    return F.concat(*map(each, sizes))


def _keys_of_tokens(tokens: Column) -> Column:
    """What a course is met by: how its words begin, what they hold, the words as initials, and their initials."""
    begins = lambda t, n: F.when(F.length(t) >= n, F.concat(F.lit(f"p{n}:"), F.left(t, F.lit(n))))
    of = lambda t: F.concat(F.array(F.when(F.length(t) == 1, F.concat(F.lit("p1:"), t)), begins(t, 2), begins(t, 3), F.when(F.length(t) >= 2, F.concat(F.lit("i:"), t))), _of_lengths(t, [1, 2, 3], "c"), _of_lengths(t, [4], "h"))
    whole = F.when(F.length(initials(tokens)) >= 2, F.concat(F.lit("w:"), initials(tokens)))
    return F.array_distinct(F.filter(F.concat(F.flatten(F.transform(tokens, of)), F.array(whole)), lambda k: k.isNotNull()))


def _keys_of_segment(s: Column) -> Column:
    """Of which a word has one if its score with the segment isn't 0: it begins as the segment does, or holds its first four characters."""
    n = F.length(s)
    return F.when(n < 3, F.array(F.concat(F.lit("p"), n, F.lit(":"), s))).when(n == 3, F.array(F.concat(F.lit("p3:"), s))).otherwise(F.array(F.concat(F.lit("p3:"), F.left(s, F.lit(3))), F.concat(F.lit("h4:"), F.left(s, F.lit(4)))))


def _keys_of_name(segments: Column) -> Column:
    """Of which a course has one if it fits a folder by initials, or by segments in one word: the initials, the only segment, the beginning of the longest one."""
    named = F.filter(segments, lambda s: ~T.is_numeric(s))
    longest = F.reduce(named, F.lit(""), lambda x, y: F.when(F.length(y) > F.length(x), y).otherwise(x))
    one = F.get(segments, F.lit(0))
    keys = F.array(
        F.when(F.length(initials(segments)) >= 2, F.concat(F.lit("i:"), initials(segments))),
        F.when((F.size(segments) == 1) & (F.length(one) >= 2), F.concat(F.lit("w:"), one)),
        F.when((F.size(named) >= 2) & (F.length(longest) > 0), F.concat(F.when(F.length(longest) > 3, "h4:").otherwise(F.concat(F.lit("c"), F.length(longest), F.lit(":"))), F.left(longest, F.lit(4)))),
    )
    return F.filter(keys, lambda k: k.isNotNull())


def candidates(courses: DataFrame, names: DataFrame) -> DataFrame:
    """(course, match_name) that may score LEAST or more, of distinct courses (course) and folders' names (match_name): a join by prefix filter.

    A folder that fits by its segments fits with more than three quarters of their length. So
    of the segments that the fewest courses have, those that make up more than a quarter are
    taken, and the course must have one of them; common words meet nobody where a rarer one
    will do. Folders that fit otherwise share their initials or a piece of one word.
    """
    asked = courses.select("course", F.explode(_keys_of_tokens(T.course_tokens(F.col("course")))).alias("key"))
    often = asked.groupBy("key").agg(F.count("*").alias("n"))
    held = names.select("match_name", T.words(F.col("match_name")).alias("segments"))
    named = held.select("match_name", F.posexplode(F.filter("segments", lambda s: ~T.is_numeric(s))).alias("nth", "s"))
    keyed = named.select("match_name", "nth", F.length("s").alias("w"), F.explode(_keys_of_segment(F.col("s"))).alias("key")).join(often, "key", "left")
    # a row for each segment of a name again, with its keys that any course has
    each = keyed.groupBy("match_name", "nth", "w").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.collect_set(F.when(F.col("n").isNotNull(), F.col("key"))).alias("keys"))
    name = Window.partitionBy("match_name")
    rarer = F.coalesce(F.sum("w").over(name.orderBy("n", "nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = each.withColumn("_rarer", rarer).withColumn("_all", F.sum("w").over(name)).where(4 * F.col("_rarer") <= F.col("_all")).select("match_name", F.explode("keys").alias("key"))
    other = held.select("match_name", F.explode(_keys_of_name(F.col("segments"))).alias("key"))
    return taken.unionByName(other).distinct().join(asked, "key").select("course", "match_name").distinct()


def suggest(courses: DataFrame, folders: DataFrame, taken: DataFrame) -> DataFrame:
    """(course, path, score): at most one folder for a course and one course for a folder; none where it isn't clear.

    courses: (course); folders: (path, match_name, downloads_leaf, modified); taken: (path).
    Names are scored once each, and only with courses that candidates() finds. Of a course's
    folders only counts, maxima and the two newest are gathered, all of them aggregated before
    the shuffle, so it doesn't matter how many fit.
    """
    wanted = courses.where(F.trim("course") != "").select("course").distinct()
    free = folders.withColumn("folder_key", T.folder_key(F.col("path"))).join(taken.select(T.folder_key(F.col("path")).alias("folder_key")).distinct(), "folder_key", "left_anti")
    pairs = candidates(wanted, free.where(F.col("match_name").isNotNull()).select("match_name").distinct())
    fitting = pairs.withColumn("score", score(F.col("course"), F.col("match_name"))).where(F.col("score") >= LEAST)
    scored = free.join(fitting, "match_name").dropDuplicates(["course", "path"])
    band = scored.join(scored.groupBy("course").agg(F.max("score").alias("best")), "course").withColumn("near", F.col("best") - F.col("score") <= BAND)
    counts = band.groupBy("course").agg(F.count_if("near").alias("nears"), F.count_if(F.col("near") & F.col("downloads_leaf")).alias("leaves"), F.max(F.when(~F.col("near"), F.col("score"))).alias("rival"))
    split = F.col("leaves").between(1, F.col("nears") - 1)
    rivals = band.join(counts, "course").where(F.col("near") & (~split | F.col("downloads_leaf"))).withColumn("n", F.when(split, F.col("leaves")).otherwise(F.col("nears")))
    newest = rivals.withColumn("nth", F.row_number().over(Window.partitionBy("course").orderBy(F.desc("modified"), "path"))).where("nth <= 2")
    first = lambda c: F.max(F.when(F.col("nth") == 1, F.col(c))).alias(c)
    picked = newest.groupBy("course").agg(*map(first, ("path", "folder_key", "score", "modified", "n", "rival")), F.max(F.when(F.col("nth") == 2, F.col("modified"))).alias("next"))
    clear = (F.col("n") == 1) | F.coalesce(F.timestamp_diff("SECOND", F.col("next"), F.col("modified")) >= NEWER_DAYS * 86400, F.lit(False))
    sure = picked.where(clear & (F.col("rival").isNull() | (F.col("score") - F.col("rival") >= LEAD)))
    one = F.row_number().over(Window.partitionBy("folder_key").orderBy(F.desc("score"), "course"))
    return sure.withColumn("nth", one).where("nth = 1").select("course", "path", "score")


def folder_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders for a course of each name of parts, among folders that parts name in several ways; some are taken."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name")
    key, name = F.col("p_partkey"), F.col("p_name")
    match = F.when(key % 4 == 0, F.initcap(name)).when(key % 4 == 1, F.left(name, F.lit(5))).when(key % 4 == 2, F.concat(F.left(name, F.lit(6)), F.lit("x"))).otherwise(F.concat(name, F.lit(" old")))
    made = parts.select(key, F.concat(F.lit("/u/"), key, F.lit("/"), match).alias("path"), match.alias("match_name"), (key % 6 == 0).alias("downloads_leaf"), F.date_add(F.lit("2020-01-01").cast("date"), (key * 7919 % 4000).cast("int")).cast("timestamp").alias("modified"))
    return suggest(parts.select(F.concat(F.lit("Studies of "), name).alias("course")), made.drop("p_partkey"), made.where(key % 9 == 0).select(F.upper("path").alias("path")))


def name_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well folders named for parts' names, shortened, joined, turned around or in initials, fit titles of names and types."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_type")
    word = lambda n: F.get(F.split("p_name", " "), F.lit(n))
    kind, n = F.col("p_partkey") % 5, (F.col("p_partkey") % 7 + 2).cast("int")
    folder = (
        F.when(kind == 0, F.concat(F.upper(F.left(word(0), n)), F.lit("-"), word(1)))
        .when(kind == 1, F.concat(F.left(word(1), n), F.lit("_"), word(0), F.lit("x")))
        .when(kind == 2, F.concat(F.left(word(0), F.lit(1)), F.left(word(1), F.lit(1))))
        .when(kind == 3, F.concat(F.left(word(0), F.lit(2)), F.lit(" "), F.right(word(0), F.lit(2)), F.lit(" 20")))
        .otherwise(F.concat(word(1), F.lit(" of old")))
    )
    title = F.concat("p_name", F.when(kind == 2, "").otherwise(F.concat(F.lit(" and the "), "p_type")))
    made = parts.select("p_partkey", title.alias("title"), folder.alias("folder"))
    return made.select("p_partkey", "title", "folder", F.round(score(F.col("title"), F.col("folder")), 6).alias("score"))


QUERIES = {"folder_suggest": folder_suggest, "name_scores": name_scores}
_WORDS = lambda x: f"list_filter(string_split(trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: NOT regexp_matches(w, '^[0-9]*$'))"
_SHARED = "len(list_filter(range(1, least(length(s), length(t)) + 1), lambda n: left(s, n) = left(t, n)))"
_PAIR = f"CASE WHEN s = t THEN 1.0 WHEN length(s) >= 2 AND starts_with(t, s) THEN 0.9 WHEN length(t) >= 3 AND starts_with(s, t) THEN 0.8 WHEN {_SHARED} >= greatest(3, length(s) - 1) THEN 0.75 WHEN length(s) >= 4 AND contains(t, s) THEN 0.7 ELSE 0.0 END"
#: From m (title, folder and other columns, rows distinct) to scored, with their score.
_SCORED = f"""
        k AS (SELECT *, row_number() OVER () AS k FROM m),
        f AS (SELECT *, {_WORDS("folder")} AS segs, list_filter({_WORDS("title")}, lambda w: w NOT IN ('and', 'the', 'of', 'in', 'for', 'a', 'an')) AS toks FROM k),
        pairs AS (SELECT k, s, nth, max({_PAIR}) AS best FROM (SELECT k, unnest(segs) AS s, generate_subscripts(segs, 1) AS nth, toks FROM f) x, unnest(toks) AS y(t) GROUP BY ALL),
        means AS (SELECT k, sum(length(s) * best) / sum(length(s)) AS mean FROM pairs GROUP BY 1),
        a AS (SELECT *, array_to_string(list_transform(segs, lambda s: left(s, 1)), '') AS own, array_to_string(list_transform(toks, lambda t: left(t, 1)), '') AS whole FROM f),
        b AS (SELECT *, CASE WHEN length(own) >= 2 AND list_contains(toks, own) THEN 0.9 WHEN len(segs) = 1 AND len(string_split(trim(folder), ' ')) = 1 AND length(segs[1]) >= 2 AND segs[1] = whole THEN 0.85 ELSE 0.0 END AS acronym,
                     CASE WHEN len(segs) = 2 AND length(segs[1]) + length(segs[2]) >= 4 AND len(list_filter(toks, lambda t: starts_with(t, segs[1]) AND contains(substr(t, length(segs[1]) + 1), segs[2]))) > 0 THEN 0.9
                          WHEN len(segs) > 2 AND len(list_filter(toks, lambda t: starts_with(t, segs[1]) AND regexp_matches(substr(t, length(segs[1]) + 1), array_to_string(segs[2:], '.*')))) > 0 THEN 0.9 ELSE 0.0 END AS compound FROM a),
        scored AS (SELECT b.*, greatest(coalesce(mean, 0), acronym, compound)::DOUBLE AS score FROM b LEFT JOIN means USING (k))"""
ORACLES = {
    "folder_suggest": f"""
        WITH d AS (SELECT p_partkey AS key, CASE p_partkey % 4 WHEN 0 THEN array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') WHEN 1 THEN left(p_name, 5) WHEN 2 THEN left(p_name, 6) || 'x' ELSE p_name || ' old' END AS folder
                   FROM part WHERE p_partkey % 9 <> 0),
        m AS (SELECT 'Studies of ' || p_name AS title, folder, '/u/' || key || '/' || folder AS path, key % 6 = 0 AS leaf, DATE '2020-01-01' + (key * 7919 % 4000)::INT AS modified FROM d, (SELECT DISTINCT p_name FROM part)), {_SCORED},
        near AS (SELECT *, max(score) OVER (PARTITION BY title) - score <= 0.1 AS near FROM scored WHERE score >= 0.75),
        n AS (SELECT *, count(*) FILTER (near AND leaf) OVER (PARTITION BY title) AS leaves, count(*) FILTER (near) OVER (PARTITION BY title) AS nears, max(score) FILTER (NOT near) OVER (PARTITION BY title) AS rival FROM near),
        i AS (SELECT *, row_number() OVER w AS nth, lead(modified) OVER w AS next, count(*) OVER (PARTITION BY title) AS n FROM n WHERE near AND (leaf OR leaves = 0 OR leaves = nears) WINDOW w AS (PARTITION BY title ORDER BY modified DESC, path)),
        s AS (SELECT *, row_number() OVER (PARTITION BY lower(path) ORDER BY score DESC, title) AS first FROM i WHERE nth = 1 AND (n = 1 OR modified - next >= 14) AND (rival IS NULL OR score - rival >= 0.08))
        SELECT title AS course, path, score FROM s WHERE first = 1""",
    "name_scores": f"""
        WITH p AS (SELECT p_partkey, p_partkey % 5 AS kind, (p_partkey % 7 + 2)::INT AS n, string_split(p_name, ' ') AS w, p_name, p_type FROM part),
        m AS (SELECT p_partkey, p_name || CASE WHEN kind = 2 THEN '' ELSE ' and the ' || p_type END AS title,
                     CASE kind WHEN 0 THEN upper(left(w[1], n)) || '-' || w[2] WHEN 1 THEN left(w[2], n) || '_' || w[1] || 'x' WHEN 2 THEN left(w[1], 1) || left(w[2], 1)
                               WHEN 3 THEN left(w[1], 2) || ' ' || right(w[1], 2) || ' 20' ELSE w[2] || ' of old' END AS folder FROM p), {_SCORED}
        SELECT p_partkey, title, folder, round(score, 6) AS score FROM scored""",
}
