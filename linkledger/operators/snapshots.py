"""Repeated captures of the same pages: which stay equal, where they differ, and what conditions cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import html as H
from ..functions import urls as U


def stability(captures: DataFrame, key: str, body: str) -> DataFrame:
    """Each page's captures and whether all are equal: as they are, without what always varies, and in their content only."""
    one = lambda x: F.count_distinct(F.sha2(x, 256)) == 1
    whole, bare = F.col(body), H.without_volatile(F.col(body))
    return captures.groupBy(key).agg(F.count("*").alias("captures"), one(whole).alias("equal"), one(bare).alias("equal_bare"), one(H.content_region(bare)).alias("equal_content"))


def line_differences(before: DataFrame, after: DataFrame, key: str, body: str, shown: int = 15) -> DataFrame:
    """(key, differing, first): lines that differ by place, and the first ones."""
    lines = lambda df, name: df.select(key, F.posexplode(F.split(body, "\n")).alias("line", name))
    both = lines(before, "a").join(lines(after, "b"), [key, "line"], "full").where(~F.col("a").eqNullSafe(F.col("b")))
    ranked = both.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy("line")))
    return ranked.groupBy(key).agg(F.count("*").alias("differing"), F.array_sort(F.collect_list(F.when(F.col("_nth") <= shown, F.col("line")))).alias("first"))


def by_segment(requests: DataFrame, url: str, size: str, main: str, marker: str) -> DataFrame:
    """Requests by the path's part behind a marker, `other` without: count, of main frames, and bytes."""
    part = F.regexp_extract(U.part(F.col(url), 3), rf"/{marker}/([^/?#]+)", 1)
    return requests.groupBy(F.when(part == "", "other").otherwise(part).alias("segment")).agg(F.count("*").alias("n"), F.count_if(main).alias("main_frames"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))


def top_and_rest(rows: DataFrame, key: str, most: int = 15) -> DataFrame:
    """The most frequent values, and all others as one row `(rest)`."""
    counts = rows.groupBy(F.col(key).cast("string").alias("value")).agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "value").limit(most)
    rest = counts.join(top.select("value"), "value", "left_anti").agg(F.lit("(rest)").alias("value"), F.sum("n").alias("n")).where("n > 0")
    return top.unionByName(rest)


def savings(rows: DataFrame, condition: str, cost: str, base: str) -> DataFrame:
    """Each condition's mean cost and its saving against the base, in percent."""
    means = rows.groupBy(condition).agg(F.avg(cost).alias("mean"), F.count("*").alias("n"))
    against = F.max(F.when(F.col(condition) == base, F.col("mean"))).over(Window.partitionBy(F.lit(0)))
    return means.withColumn("saving", F.try_divide(100 * (against - F.col("mean")), against))


def verdict(percent: Column) -> Column:
    """What a share says."""
    return F.when(percent > 50, "main cause").when(percent.between(20, 40), "part of it").when(percent < 10, "no cause").otherwise("unclear")


def _captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    again = pages.select("page_id", F.concat("html", F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("<i jsessionid="), "page_id", F.lit('">'))).when(F.col("page_id") % 3 == 1, "\n<b>new</b>").otherwise("")).alias("html"))
    return pages.withColumn("n", F.lit(1)).unionByName(again.withColumn("n", F.lit(2)))


def page_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages against captures that differ by fixed rules."""
    return stability(_captures(spark, sf_dir), "page_id", "html").drop("equal_content", "equal_bare")


def page_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of pages that differ from their second capture."""
    both = _captures(spark, sf_dir)
    return line_differences(both.where("n = 1"), both.where("n = 2"), "page_id", "html").select("page_id", "differing")


def segment_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by language in their path."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.regexp_replace("url", "^([a-z]+://[^/]*)/", "$1/at/").alias("url"), F.octet_length("html").cast("long").alias("size"), (F.col("page_id") % 2 == 0).alias("main"))
    return by_segment(pages, "url", "size", "main", "at")


def frequent_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent sources of documents, and the rest."""
    return top_and_rest(spark.read.parquet(f"{sf_dir}/documents.parquet").where("source is not null"), "source", 5)


def condition_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean prices by return flag against one of them."""
    return savings(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_returnflag", "l_extendedprice", "N").select("l_returnflag", "n", F.round("mean", 6).alias("mean"), F.round("saving", 6).alias("saving"))


QUERIES = {f.__name__: f for f in (page_stability, page_differences, segment_rollup, frequent_sources, condition_savings)}
ORACLES = {
    "page_stability": "SELECT page_id, 2::BIGINT AS captures, page_id % 3 = 2 AS equal FROM pages",
    "page_differences": "SELECT page_id, 1::BIGINT AS differing FROM pages WHERE page_id % 3 <> 2",
    "segment_rollup": "SELECT coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/]*/([^/?#]+)', 1), ''), 'other') AS segment, count(*) AS n, count(*) FILTER (page_id % 2 = 0) AS main_frames, sum(strlen(html))::BIGINT AS bytes FROM pages GROUP BY 1",
    "frequent_sources": """
        WITH c AS (SELECT source AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, source) AS nth FROM documents WHERE source IS NOT NULL GROUP BY 1)
        SELECT CASE WHEN nth <= 5 THEN value ELSE '(rest)' END AS value, sum(n)::BIGINT AS n FROM c GROUP BY 1""",
    "condition_savings": """
        WITH m AS (SELECT l_returnflag, count(*) AS n, avg(l_extendedprice) AS mean FROM lineitem GROUP BY 1)
        SELECT l_returnflag, n, round(mean, 6) AS mean, round(100 * ((SELECT mean FROM m WHERE l_returnflag = 'N') - mean) / (SELECT mean FROM m WHERE l_returnflag = 'N'), 6) AS saving FROM m""",
}
