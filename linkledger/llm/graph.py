"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _spark as S


#: Edges in a partition, about.
ROWS = 50_000


def _counted(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """edges (hi, lo), cut, in partitions that follow their number; and their number with a sum of hashes."""
    held = S.cut(edges)
    now = tuple(held.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
    return held.coalesce(8 + now[0] // ROWS), now


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `edges` (a long, b long); root is the smallest node reachable.

    Each round's edges are checkpointed, in partitions that follow their number. Minima are
    aggregated before the shuffle, and the joins that spread them may be split by adaptive
    execution, so a node with very many neighbours doesn't stay in one task. Self-loops and
    repeated edges are allowed.
    """
    stars, before = _counted(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    for _ in range(rounds):
        both = stars.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(stars.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large, now = _counted(both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")))
        if now == before:  # each node has one edge, to the least one of its star
            break
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(least.select("hi", F.col("m").alias("lo")))
        stars, before = _counted(small.coalesce(8 + now[0] // ROWS).distinct())
    else:
        raise RuntimeError(f"no end of the search for components after {rounds} rounds")
    return stars.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(stars.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
