"""Small Spark helpers that several operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores before it while a column of df has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; only where one machine is all there is, as in tests, a folder of our own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder; later jobs read it from there, whichever executors are lost."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def gathered(df: DataFrame, each: int = 50_000, least: int = 8) -> DataFrame:
    """df, cut, in partitions of about `each` rows: small tables don't become shuffle files of a few bytes for every pair of tasks."""
    held = cut(df)
    return held.coalesce(max(least, -(-held.count() // each)))


def written(df: DataFrame) -> DataFrame:
    """df as a table of Parquet files in the shared checkpoint folder; smaller than a checkpoint."""
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket_count(docs: DataFrame, text: str, each: int = 16 << 20, least: int = 8) -> int:
    """Buckets of about `each` bytes of text, and `least` at least; follows the bytes, however few rows hold them."""
    total = docs.select(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    return max(least, -(-total // each))


def running_total(df: DataFrame, order: list[str], value: str | Column, name: str) -> DataFrame:
    """Adds `name`: the sum of `value` over all rows before each row in the given order.

    Rows are range-partitioned; only one row per partition, its total, meets in a
    single task. `order` should be unique, else the order of equal rows is arbitrary.
    """
    at, own, part, before = (free_name(df, c) for c in ("_at", "_own", "_part", "_before"))
    n = shuffle_partitions(df.sparkSession)
    value = F.col(value) if isinstance(value, str) else value
    placed = cut(df.withColumn(own, value.cast("long")).repartitionByRange(n, *order).withColumn(part, F.spark_partition_id()))
    totals = placed.groupBy(part).agg(F.sum(own).alias(at))
    heads = totals.select(part, F.coalesce(F.sum(at).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before))
    inside = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return placed.join(F.broadcast(heads), part).withColumn(name, F.col(before) + F.coalesce(F.sum(own).over(inside), F.lit(0))).drop(at, own, part, before)
