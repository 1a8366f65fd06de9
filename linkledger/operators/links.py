"""Queries over the links of captured pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ANCHOR = r"(?is)<a\s([^>]*)>(.*?)</a>"


def link_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many anchors, and how many distinct targets, each page has."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    anchors = F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(1))
    hrefs = F.transform(anchors, lambda a: F.regexp_extract(a, r'(?i)\bhref="([^"]*)"', 1))
    return pages.select("page_id", F.size(anchors).cast("long").alias("n_links"), F.size(F.array_distinct(F.filter(hrefs, lambda h: h != ""))).cast("long").alias("n_targets"))


QUERIES = {"link_inventory": link_inventory}
ORACLES = {
    "link_inventory": r"""
        SELECT page_id, len(regexp_extract_all(html, '<a\s([^>]*)>(.*?)</a>', 0, 'is'))::BIGINT AS n_links,
               len(list_distinct(list_filter(list_transform(regexp_extract_all(html, '<a\s([^>]*)>(.*?)</a>', 1, 'is'), lambda a: regexp_extract(a, '\bhref="([^"]*)"', 1, 'i')), lambda h: h <> '')))::BIGINT AS n_targets
        FROM pages""",
}
