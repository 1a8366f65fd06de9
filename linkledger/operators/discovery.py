"""What was found where: courses from their cards, counts, and signs that something was missed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import predicates as P
from ..functions import text as T
from ..functions import urls as U
from ..sources.tables import in_order

#: Link texts that are no course titles, and what a title without name begins with.
NO_TITLES = ["kurs öffnen", "weitere kursinhalte ansehen", "weitere kursinhalte", "kursinhalte ansehen", "zum kurs", "kurs starten", "details anzeigen", "mehr anzeigen", "inhalte anzeigen", "was lernt man in diesem kurs"]
NAMELESS = "RepositoryEntry "


def courses(cards: DataFrame, base: str, wanted: list[str] | None = None) -> DataFrame:
    """(entry, title, url) of cards (seq, href, title): of each entry the longest title in bytes, the first of equal ones.

    A title that only names the entry's number gives way to any other.
    """
    link, title = U.resolve(F.lit(base), T.strip(F.col("href"))), T.strip(F.col("title"))
    rows = cards.select("seq", U.entry_id(link).alias("entry"), title.alias("title")).where((F.col("entry") != "") & (F.col("title") != "") & (T.strip(F.col("href")) != ""))
    fine = rows.where(~T.contains_any(F.lower("title"), NO_TITLES) & P.course_wanted(F.col("title"), wanted or []))
    rank = F.struct(~F.col("title").startswith(NAMELESS), F.octet_length("title"), -F.col("seq"))
    best = fine.groupBy("entry").agg(F.max_by("title", rank).alias("title"))
    return best.select("entry", "title", U.resolve(F.lit(base), F.concat(F.lit("auth/RepositoryEntry/"), "entry")).alias("url"))


def course_index(files: DataFrame) -> DataFrame:
    """(course, course_index, total_courses): courses numbered from 1 in the order of their first path."""
    first = files.groupBy("course").agg(F.min("path").alias("first"))
    numbered = in_order(first, ["first", "course"], "nth")
    return numbered.join(F.broadcast(first.agg(F.count("*").cast("int").alias("total_courses")))).select("course", (F.col("nth") + 1).cast("int").alias("course_index"), "total_courses")


def truncated(before: Column, after: Column) -> Column:
    """Whether a list that should have grown by showing all entries did not."""
    return (before > 0) & (after <= before)


def all_failed(total: Column, failed: Column) -> Column:
    return (total > 0) & (failed == total)


def coverage(known: DataFrame, visited: DataFrame) -> DataFrame:
    """(course, n_known, n_visited, missing, extra): sections by course and key on either side."""
    both = known.select("course", "key").distinct().withColumn("k", F.lit(1)).join(visited.select("course", "key").distinct().withColumn("v", F.lit(1)), ["course", "key"], "full")
    return both.groupBy("course").agg(F.count("k").alias("n_known"), F.count("v").alias("n_visited"), F.count_if(F.col("v").isNull()).alias("missing"), F.count_if(F.col("k").isNull()).alias("extra"))


def course_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as cards of nations' courses."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    title = F.when(F.col("s_suppkey") % 5 == 0, F.concat(F.lit(NAMELESS), "s_nationkey")).when(F.col("s_suppkey") % 7 == 0, "Kurs öffnen").otherwise(F.concat(F.lit(" "), "s_name", F.repeat(F.lit("x"), (F.col("s_suppkey") % 3).cast("int"))))
    return courses(s.select(F.col("s_suppkey").alias("seq"), F.concat(F.lit("/auth/RepositoryEntry/"), "s_nationkey", F.lit("/x")).alias("href"), title.alias("title")), "https://h.example/")


def course_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market segments in the order of their first customer."""
    return course_index(spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_mktsegment").alias("course"), F.col("c_name").alias("path")))


def section_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by kind of event in the first half of the month against the second one."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("course"), F.col("user_id").alias("key"), F.dayofmonth("ts").alias("day"))
    return coverage(e.where("day <= 15"), e.where("day > 15"))


QUERIES = {f.__name__: f for f in (course_cards, course_order, section_coverage)}
ORACLES = {
    "course_cards": """
        WITH c AS (SELECT s_suppkey AS seq, s_nationkey::VARCHAR AS entry, CASE WHEN s_suppkey % 5 = 0 THEN 'RepositoryEntry ' || s_nationkey WHEN s_suppkey % 7 = 0 THEN 'Kurs öffnen' ELSE s_name || repeat('x', (s_suppkey % 3)::INT) END AS title FROM supplier),
        r AS (SELECT *, row_number() OVER (PARTITION BY entry ORDER BY starts_with(title, 'RepositoryEntry '), strlen(title) DESC, seq) AS nth FROM c WHERE title <> 'Kurs öffnen')
        SELECT entry, title, 'https://h.example/auth/RepositoryEntry/' || entry AS url FROM r WHERE nth = 1""",
    "course_order": "WITH f AS (SELECT c_mktsegment AS course, min(c_name) AS first FROM customer GROUP BY 1) SELECT course, row_number() OVER (ORDER BY first, course)::INT AS course_index, (count(*) OVER ())::INT AS total_courses FROM f",
    "section_coverage": """
        WITH e AS (SELECT DISTINCT event_type AS course, user_id AS key, day(ts) <= 15 AS early FROM events),
        b AS (SELECT course, key, bool_or(early) AS k, bool_or(NOT early) AS v FROM e GROUP BY 1, 2)
        SELECT course, count(*) FILTER (k) AS n_known, count(*) FILTER (v) AS n_visited, count(*) FILTER (NOT v) AS missing, count(*) FILTER (NOT k) AS extra FROM b GROUP BY 1""",
}
