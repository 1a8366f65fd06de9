"""Queries that apply the functions for names, words, numbers and times to whole columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as T
from . import messages as M

NOW = "2024-02-01 00:00:00"


def match_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the documents' texts as patterns see them, and with their letters folded."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return docs.select("doc_id", F.md5(T.match_text(F.col("text"))).alias("match"), F.md5(T.fold(F.col("text"))).alias("fold"))


def course_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The telling words of titles made of parts' types and names, with grammar and semesters around them."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_type")
    title = F.concat(F.lit("Theorie der "), F.lower("p_type"), F.lit(" und the "), "p_name", F.lit(" (WiSe 26) zur Modul"), (F.col("p_partkey") % 7).cast("string"))
    return parts.select("p_partkey", F.array_join(T.course_tokens(title), " ").alias("tokens"))


def event_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of events' properties read leniently, and as percents, bars, times of day and shortened texts."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value", "props")
    number = F.regexp_extract("props", r"(\d+)", 1)
    time = F.concat(F.lpad((F.col("event_id") % 30).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.col("event_id") % 70).cast("string"), 2, "0"))
    return e.select(
        "event_id",
        T.int_or_zero(F.concat(F.when(F.col("event_id") % 4 == 0, "x").otherwise(" "), number)).alias("number"),
        T.percent(number.cast("int"), F.col("event_id") % 90).alias("percent"),
        T.bar(F.col("value")).alias("bar"),
        T.is_time_of_day(time).alias("is_time"),
        T.scattered_minute(F.col("event_type")).alias("minute"),
        T.shorten(F.concat("event_type", "props"), 12).alias("short"),
        T.folder_key(F.concat(F.lit("C:\\Users//"), "event_type", F.lit("/./"), "user_id", F.lit("/"))).alias("folder"),
    )


def event_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long ago events were, and the values as seconds that are left, in words."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    return e.select("event_id", T.since(F.col("ts"), F.lit(NOW).cast("timestamp")).alias("since"), T.remaining(F.col("value") * 500 - 5000).alias("left"))


def exit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exit code of each kind of event as a failure."""
    kinds = F.create_map(*(F.lit(x) for pair in (("view", "not_ready"), ("click", "already_running"), ("error", "offline"), ("purchase", "already_succeeded")) for x in pair))
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type")
    return e.groupBy("event_type", M.exit_code(F.coalesce(F.element_at(kinds, F.col("event_type")), F.lit("other"))).alias("code")).agg(F.count("*").alias("n"))


def message_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What kind of failure a document's text would tell of, and whether it would be shown."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    tell = F.get(F.array(*map(F.lit, ["Timeout of ", "Navigation to ", "page crashed ", "target Closed ", ""])), (F.col("doc_id") % 5).cast("int"))
    level = (F.col("doc_id") % 3 * 4).cast("int")
    return docs.select("doc_id", P.error_kind(F.concat(tell, "text")).alias("kind"), P.shown_on_console(level, F.when(F.col("doc_id") % 2 == 0, "user").otherwise("log"), False).alias("shown"))


def header_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line prices as content lengths of headers in several spellings, and some that are none."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", F.floor("l_extendedprice").cast("string").alias("n"))
    name = F.get(F.array(*map(F.lit, ["Content-Length", "content-length", "CONTENT-LENGTH", "Length"])), (F.col("l_orderkey") % 4).cast("int"))
    value = F.when(F.col("l_partkey") % 5 == 0, F.concat("n", F.lit("b"))).otherwise(F.concat(F.lit(" "), "n"))
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", T.content_length(F.create_map(F.lit("Accept"), F.lit("12"), name, value)).alias("length"))


QUERIES = {f.__name__: f for f in (header_lengths, match_texts, course_words, event_values, event_ages, exit_codes, message_kinds)}
ORACLES = {
    "header_lengths": "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_orderkey % 4 = 3 OR l_partkey % 5 = 0 THEN 0 ELSE floor(l_extendedprice)::BIGINT END AS length FROM lineitem",
    "match_texts": r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(nfc_normalize(strip_accents(lower(text))), '\p{Mn}', '', 'g'), '[\s\pZ]+', ' ', 'g'))) AS match,
        md5(replace(translate(lower(text), 'äöüáàâãåéèêëíìîïóòôõøúùûñçý', 'aouaaaaaeeeeiiiiooooouuuncy'), 'ß', 'ss')) AS fold FROM documents""",
    "course_words": """
        WITH w AS (SELECT p_partkey, string_split(trim(regexp_replace(lower('Theorie ' || p_type || ' ' || p_name), '[^a-z]+', ' ', 'g')), ' ') AS w FROM part)
        SELECT p_partkey, array_to_string(list_filter(w, lambda x: x NOT IN ('the', 'of', 'for', 'and', 'a', 'an', 'in')), ' ') AS tokens FROM w""",
    "event_values": r"""
        WITH e AS (SELECT *, regexp_extract(props, '(\d+)', 1)::INT AS n, event_id % 90 AS whole, lpad((event_id % 30)::VARCHAR, 2, '0') AS hh, event_id % 70 AS mm, event_type || props AS t, round(greatest(0, least(100, value)) / 100 * 20)::INT AS nf FROM events)
        SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 0 ELSE n END AS number, CASE WHEN whole <= 0 THEN 0 ELSE n * 100 // whole END::INT AS percent, rpad(repeat('#', nf), 20, '.') AS bar, hh < '24' AND mm < 60 AS is_time,
            '06:' || lpad((list_reduce(list_prepend(0, list_transform(string_split(event_type, ''), lambda c: ascii(c)::HUGEINT)), lambda x, y: (x * 31 + y) % 4294967296) % 60)::VARCHAR, 2, '0') AS minute,
            CASE WHEN length(t) > 12 THEN substr(t, 1, 11) || '…' ELSE t END AS short, 'c:/users/' || event_type || '/' || user_id AS folder FROM e""",
    "event_ages": f"""
        WITH e AS (SELECT event_id, ts, datediff('second', ts, TIMESTAMP '{NOW}') - CASE WHEN date_part('microsecond', ts) % 1000000 > 0 THEN 1 ELSE 0 END AS s, value * 500 - 5000 AS l FROM events)
        SELECT event_id, CASE WHEN s < 120 THEN 'just now' WHEN s < 3600 THEN (s // 60) || ' minutes ago' WHEN s < 7200 THEN '1 hour ago' WHEN s < 86400 THEN (s // 3600) || ' hours ago' WHEN s < 172800 THEN 'yesterday'
                WHEN s < 604800 THEN (s // 86400) || ' days ago' ELSE day(ts) || ' Jan 2024' END AS since,
            CASE WHEN l <= 0 THEN '' WHEN l < 120 THEN 'under a minute' WHEN l < 3600 THEN floor(l / 60)::INT || ' minutes' WHEN l < 7200 THEN '1 hour' WHEN l < 172800 THEN floor(l / 3600)::INT || ' hours' ELSE floor(l / 86400)::INT || ' days' END AS left FROM e""",
    "exit_codes": "SELECT event_type, CASE event_type WHEN 'view' THEN 3 WHEN 'click' THEN 4 WHEN 'error' THEN 5 WHEN 'purchase' THEN 6 ELSE 1 END AS code, count(*) AS n FROM events GROUP BY 1, 2",
    "message_kinds": """
        WITH d AS (SELECT doc_id, lower((['Timeout of ', 'Navigation to ', 'page crashed ', 'target Closed ', ''])[(doc_id % 5)::INT + 1] || text) AS m FROM documents)
        SELECT doc_id, CASE WHEN contains(m, 'timeout') THEN 'timeout' WHEN contains(m, 'execution context was destroyed') THEN 'context-destroyed' WHEN contains(m, 'navigat') THEN 'navigation' WHEN contains(m, 'crash') THEN 'crash'
            WHEN contains(m, 'closed') THEN 'closed' ELSE 'other' END AS kind, doc_id % 3 = 2 OR doc_id % 2 = 0 AS shown FROM d""",
}
