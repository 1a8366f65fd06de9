"""Snapshots of usage windows, and when to ask again after failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: Seconds between requests, seconds of the longest wait and of the wait after a refusal, age that is stale, clock slip allowed.
INTERVAL, LONGEST, REFUSED, STALE, SLIP = 300, 3600, 120, 900, 120


def window_state(present: Column, percent: Column, resets_at: Column, now: Column) -> Column:
    """What a usage window's snapshot is worth: missing, rolled_over (its end has passed), no_percent or ok."""
    over = F.coalesce(T.reset_time(resets_at) <= now, F.lit(False))
    return F.when(~present, "missing").when(over, "rolled_over").when(T.finite(percent).isNull(), "no_percent").otherwise("ok")


def age(fetched_at: Column, now: Column) -> Column:
    """Seconds since a snapshot; infinite where it has no time, or one well in the future."""
    passed = now - T.finite(fetched_at)
    return F.when(passed.isNull() | (passed < -SLIP), float("inf")).otherwise(F.greatest(passed, F.lit(0.0)))


def next_attempt(planned: Column, now: Column) -> Column:
    """When to ask again; at once where the plan is missing or farther off than any wait."""
    return F.when(T.finite(planned).isNull() | (planned > now + LONGEST), 0.0).otherwise(planned)


def wait(failures: Column, status: Column, retry_after: Column) -> Column:
    """Seconds to wait after so many failures in a row: doubling up to the longest, at least what the answer asks for, little after a refusal."""
    doubled = F.least(INTERVAL * F.pow(F.lit(2.0), F.least(failures, F.lit(20))), F.lit(float(LONGEST)))
    asked = F.least(F.coalesce(retry_after, F.lit(0)), F.lit(LONGEST)).cast("double")
    return F.when(status == 401, float(REFUSED)).otherwise(F.greatest(doubled, asked))


def usage_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as snapshots: their state, age and wait."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value", "user_id")
    id_ = F.col("event_id")
    resets = F.when(id_ % 4 == 0, "2024-01-01 00:00:00").when(id_ % 4 == 1, "1800000000").when(id_ % 4 == 2, "soon")
    percent = F.when(id_ % 5 != 0, F.col("value"))
    state = window_state(id_ % 7 != 0, percent, resets, F.lit("2024-06-01 00:00:00").cast("timestamp"))
    old = age(F.when(id_ % 3 != 0, id_.cast("double")), F.lit(500.0))
    return e.select("event_id", state.alias("state"), F.when(old > STALE, "stale").when(old > 0, "aged").otherwise("fresh").alias("age"), wait(id_ % 6, F.when(id_ % 11 == 0, 401).otherwise(500), (F.col("user_id") * 100).cast("int")).alias("wait"), next_attempt(id_.cast("double"), F.lit(100.0)).alias("next"))


QUERIES = {"usage_windows": usage_windows}
ORACLES = {
    "usage_windows": """
        SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'missing' WHEN event_id % 4 = 0 THEN 'rolled_over' WHEN event_id % 5 = 0 OR value IS NULL THEN 'no_percent' ELSE 'ok' END AS state,
               CASE WHEN event_id % 3 = 0 OR 500 - event_id < -120 THEN 'stale' WHEN 500 - event_id > 0 THEN 'aged' ELSE 'fresh' END AS age,
               CASE WHEN event_id % 11 = 0 THEN 120 ELSE greatest(least(300 * 2 ** (event_id % 6), 3600), least(user_id * 100, 3600)) END::DOUBLE AS wait, CASE WHEN event_id > 3700 THEN 0 ELSE event_id END::DOUBLE AS next FROM events""",
}
