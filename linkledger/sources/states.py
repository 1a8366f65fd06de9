"""The state of runs as a table of which a run rewrites only the parts that it touches."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changes
from .tables import checkpoint_folder, cut

#: Parts of a state, by a hash of the key, and buckets of a part.
PARTS, BUCKETS = 64, 16
COLUMNS = ["key", "size", "modified", "fail_count", "failed_at", "unverified"]


def part_of(key: Column, parts: int = PARTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def create(state: DataFrame, table: str, path: str, parts: int = PARTS, buckets: int = BUCKETS) -> None:
    """A state (COLUMNS) as a table at a path, in parts by key and in sorted buckets of each.

    With as many buckets as a shuffle has partitions, or more, a run's join reads the state as it lies.
    """
    placed = state.select(*COLUMNS, part_of(F.col("key"), parts).alias("part")).repartition("part")  # a file for each bucket of a part, not for each task
    placed.write.option("path", path).partitionBy("part").bucketBy(buckets, "key").sortBy("key").saveAsTable(table)
    placed.sparkSession.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('parts' = '{parts}')")


def parts_of(spark: SparkSession, table: str) -> int:
    return int(spark.sql(f"SHOW TBLPROPERTIES {table}('parts')").first()["value"])


def merged(spark: SparkSession, table: str, planned: DataFrame, outcomes: DataFrame, now: Column) -> tuple[DataFrame, list[int]]:
    """What changes.merge makes of the touched parts' records, and the numbers of these parts; only they are read, and not shuffled."""
    parts = parts_of(spark, table)
    tried = planned.join(outcomes.select("key"), "key", "left_semi")
    touched = sorted(r["part"] for r in tried.select(part_of(F.col("key"), parts).alias("part")).distinct().collect())  # as many as the state has parts at most
    state = spark.table(table).where(F.col("part").isin(touched)).drop("part") if touched else spark.table(table).where("false").drop("part")
    return changes.merge(state, planned, outcomes, now), touched


def apply(spark: SparkSession, table: str, planned: DataFrame, outcomes: DataFrame, now: Column) -> list[int]:
    """Records a run's outcomes (key, status) in the table, as changes.merge does; returns the parts that were rewritten.

    New records are cut before they are written, so that no task has to read again what the
    same job replaces. One run at a time.
    """
    new, touched = merged(spark, table, planned, outcomes, now)
    if touched:
        parts = parts_of(spark, table)
        kinds = dict(spark.table(table).dtypes)
        held = cut(new.select(*(F.col(c).cast(kinds[c]).alias(c) for c in COLUMNS), part_of(F.col("key"), parts).alias("part")))
        before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        try:
            held.repartition("part").write.insertInto(table, overwrite=True)
        finally:
            spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)
    return touched


def state_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state after a run, read from a table in which the run recorded it."""
    listing, state, present = changes._orders(spark, sf_dir)
    name = f"state_{uuid.uuid4().hex}"
    create(state, name, f"{checkpoint_folder(spark)}/{name}", parts=8)
    planned = changes.plan(listing, spark.table(name).drop("part"), present, F.lit(changes.NOW).cast("timestamp"))
    status = F.when(F.col("key").cast("long") % 8 == 0, "failed").when(F.col("action") == "VERIFY", "unchanged").otherwise("ok")
    planned = cut(planned)  # it was planned by the state as it was
    apply(spark, name, planned, planned.where(F.col("action").isin("DOWNLOAD", "VERIFY")).select("key", status.alias("status")), F.lit(changes.NOW))
    return spark.table(name).drop("part")


QUERIES = {"state_runs": state_runs}
ORACLES = {"state_runs": changes.ORACLES["state_merge"]}
