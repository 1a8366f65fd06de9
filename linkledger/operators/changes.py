"""What a synchronisation would do: comparing a listing with the state of the last run, and merging outcomes into it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Hours to wait after the first, second, ... failure; the first entry is for none.
BACKOFF_HOURS = [0, 6, 24, 72, 168]


def changed(size: Column, modified: Column, known: Column, old_size: Column, old_modified: Column) -> Column:
    """Whether an entry is new, or tells a size or date other than the recorded one. Signals that are now missing tell nothing."""
    differs = lambda now, old: now.isNotNull() & ~now.eqNullSafe(old)
    return ~known | differs(size, old_size) | differs(modified, old_modified)


def needs_verification(known: Column, unverified: Column, old_size: Column, old_modified: Column) -> Column:
    """Whether a recorded entry can't be told from its record alone."""
    return known & (F.coalesce(unverified, F.lit(False)) | (old_size.isNull() & old_modified.isNull()))


def backoff_hours(failures: Column) -> Column:
    """Hours to wait after so many failures in a row; the last step is for all beyond."""
    steps = F.array(*map(F.lit, BACKOFF_HOURS))
    return F.when(failures <= 0, 0).otherwise(F.element_at(steps, F.least(failures, F.lit(len(BACKOFF_HOURS) - 1)).cast("int") + 1))


def retry_at(failures: Column, failed_at: Column) -> Column:
    """When a failed entry may be tried again; null if it didn't fail or the time can't be read."""
    at = F.try_to_timestamp(failed_at.cast("string"))
    return F.when(failures > 0, at + F.make_dt_interval(F.lit(0), backoff_hours(failures)))


def plan(listing: DataFrame, state: DataFrame, present: DataFrame, now: Column, force: bool = False) -> DataFrame:
    """listing (key, path, url, size, modified) with action: COLLISION, BACKOFF, DOWNLOAD, VERIFY or SKIP.

    Of entries with one key, the first by path and address stays, the others collide.
    state: (key, size, modified, fail_count, failed_at, unverified); present: the keys
    of files that are there. One sort-merge join each, on the key.
    """
    first = F.row_number().over(Window.partitionBy("key").orderBy("path", "url")) == 1
    old = state.select("key", F.lit(True).alias("_known"), F.col("size").alias("_size"), F.col("modified").alias("_modified"), "fail_count", "failed_at", "unverified")
    there = present.select("key", F.lit(True).alias("_there")).distinct()
    joined = listing.withColumn("_first", first).join(old, "key", "left").join(there, "key", "left")
    known = F.coalesce("_known", F.lit(False))
    waiting = F.coalesce(retry_at(F.col("fail_count"), F.col("failed_at")) > now, F.lit(False)) & F.lit(not force)
    new = F.lit(force) | changed(F.col("size"), F.col("modified"), known, F.col("_size"), F.col("_modified"))
    check = needs_verification(known, F.col("unverified"), F.col("_size"), F.col("_modified"))
    action = F.when(~F.col("_first"), "COLLISION").when(waiting, "BACKOFF").when(new | F.col("_there").isNull(), "DOWNLOAD").when(check, "VERIFY").otherwise("SKIP")
    return joined.select(*listing.columns, action.alias("action"))


def merge(state: DataFrame, planned: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """The next state: one full join of the records with what was tried. Records that weren't touched stay; none is deleted.

    outcomes: (key, status) with `ok`, `unchanged` or `failed`.
    """
    tried = planned.where(F.col("action").isin("DOWNLOAD", "VERIFY")).select("key", F.col("size").alias("_size"), F.col("modified").alias("_modified"))
    done = tried.join(outcomes, "key")
    both = state.join(done, "key", "full")
    ok, same, failed = (F.coalesce(F.col("status") == s, F.lit(False)) for s in ("ok", "unchanged", "failed"))
    return both.select(
        "key",
        F.when(ok, F.col("_size")).otherwise(F.col("size")).alias("size"),
        F.when(ok, F.col("_modified")).otherwise(F.col("modified")).alias("modified"),
        F.when(ok, 0).when(failed, F.coalesce("fail_count", F.lit(0)) + 1).otherwise(F.col("fail_count")).alias("fail_count"),
        F.when(ok, F.lit(None)).when(failed, now.cast("string")).otherwise(F.col("failed_at")).alias("failed_at"),
        F.when(ok | same, False).otherwise(F.coalesce("unverified", F.lit(False))).alias("unverified"),
    )


# Orders stand for a listing; a snapshot that differs by fixed rules stands for the state.


def _orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    key = F.col("o_orderkey")
    listing = orders.select(key.cast("string").alias("key"), key.cast("string").alias("path"), F.col("o_custkey").cast("string").alias("url"), F.when(key % 7 != 0, F.floor("o_totalprice").cast("long")).alias("size"), F.when(key % 5 != 0, F.col("o_orderpriority")).alias("modified"))
    state = orders.where(key % 4 != 0).select(
        key.cast("string").alias("key"),
        F.when(key % 3 != 0, F.floor("o_totalprice").cast("long") + F.when(key % 11 == 0, 1).otherwise(0)).alias("size"),
        F.when(key % 6 != 0, F.col("o_orderpriority")).alias("modified"),
        F.when(key % 9 == 0, (key % 7).cast("int")).otherwise(0).alias("fail_count"),
        F.when(key % 9 == 0, F.lit("2024-01-10 00:00:00")).alias("failed_at"),
        (key % 13 == 0).alias("unverified"),
    )
    present = orders.where(key % 10 != 1).select(key.cast("string").alias("key"))
    return listing, state, present


NOW = "2024-01-12 00:00:00"


def change_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What would be done with each entry."""
    return plan(*_orders(spark, sf_dir), F.lit(NOW).cast("timestamp"))


def backoff_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that failed, and whether they may be tried again."""
    _, state, _ = _orders(spark, sf_dir)
    ready = retry_at(F.col("fail_count"), F.col("failed_at")) <= F.lit(NOW).cast("timestamp")
    return state.where("fail_count > 0").select("key", "fail_count", backoff_hours(F.col("fail_count")).alias("hours"), ready.alias("ready"))


def state_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state after a run with outcomes by fixed rules."""
    listing, state, present = _orders(spark, sf_dir)
    planned = plan(listing, state, present, F.lit(NOW).cast("timestamp"))
    status = F.when(F.col("key").cast("long") % 8 == 0, "failed").when(F.col("action") == "VERIFY", "unchanged").otherwise("ok")
    outcomes = planned.where(F.col("action").isin("DOWNLOAD", "VERIFY")).select("key", status.alias("status"))
    return merge(state, planned, outcomes, F.lit(NOW))


_ORDERS = f"""
    WITH listing AS (SELECT o_orderkey AS k, o_orderkey::VARCHAR AS key, o_orderkey::VARCHAR AS path, o_custkey::VARCHAR AS url,
                            CASE WHEN o_orderkey % 7 <> 0 THEN floor(o_totalprice)::BIGINT END AS size, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS modified FROM orders),
    state AS (SELECT o_orderkey::VARCHAR AS key, CASE WHEN o_orderkey % 3 <> 0 THEN floor(o_totalprice)::BIGINT + CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END END AS size,
                     CASE WHEN o_orderkey % 6 <> 0 THEN o_orderpriority END AS modified, CASE WHEN o_orderkey % 9 = 0 THEN (o_orderkey % 7)::INT ELSE 0 END AS fail_count,
                     CASE WHEN o_orderkey % 9 = 0 THEN '2024-01-10 00:00:00' END AS failed_at, o_orderkey % 13 = 0 AS unverified FROM orders WHERE o_orderkey % 4 <> 0),
    planned AS (SELECT l.*, CASE WHEN s.fail_count > 0 AND s.failed_at::TIMESTAMP + ([0, 6, 24, 72, 168])[least(s.fail_count, 4) + 1] * INTERVAL 1 HOUR > TIMESTAMP '{NOW}' THEN 'BACKOFF'
                              WHEN s.key IS NULL OR (l.size IS NOT NULL AND l.size IS DISTINCT FROM s.size) OR (l.modified IS NOT NULL AND l.modified IS DISTINCT FROM s.modified) OR k % 10 = 1 THEN 'DOWNLOAD'
                              WHEN s.unverified OR (s.size IS NULL AND s.modified IS NULL) THEN 'VERIFY' ELSE 'SKIP' END AS action
                FROM listing l LEFT JOIN state s USING (key))"""
QUERIES = {"change_plan": change_plan, "backoff_eligible": backoff_eligible, "state_merge": state_merge}
ORACLES = {
    "change_plan": f"{_ORDERS} SELECT key, path, url, size, modified, action FROM planned",
    "backoff_eligible": f"{_ORDERS} SELECT key, fail_count, ([0, 6, 24, 72, 168])[least(fail_count, 4) + 1]::INT AS hours, failed_at::TIMESTAMP + ([0, 6, 24, 72, 168])[least(fail_count, 4) + 1] * INTERVAL 1 HOUR <= TIMESTAMP '{NOW}' AS ready FROM state WHERE fail_count > 0",
    "state_merge": f"""{_ORDERS}, done AS (SELECT key, size, modified, CASE WHEN k % 8 = 0 THEN 'failed' WHEN action = 'VERIFY' THEN 'unchanged' ELSE 'ok' END AS status FROM planned WHERE action IN ('DOWNLOAD', 'VERIFY'))
        SELECT key, CASE WHEN status = 'ok' THEN d.size ELSE s.size END AS size, CASE WHEN status = 'ok' THEN d.modified ELSE s.modified END AS modified,
               CASE WHEN status = 'ok' THEN 0 WHEN status = 'failed' THEN coalesce(fail_count, 0) + 1 ELSE fail_count END AS fail_count,
               CASE WHEN status = 'ok' THEN NULL WHEN status = 'failed' THEN '{NOW}' ELSE failed_at END AS failed_at,
               CASE WHEN status IN ('ok', 'unchanged') THEN false ELSE coalesce(unverified, false) END AS unverified
        FROM state s FULL JOIN done d USING (key)""",
}
