"""Moving recorded keys to new ones without guessing: only what pairs one to one moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The key scheme is in doubt when fewer than one in so many recorded keys are found again.
SUSPECT = 4


def scheme_changed(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """One row: stored, matched and suspect, of the distinct keys."""
    both = recorded.select("key").distinct().join(current.select("key", F.lit(1).alias("hit")).distinct(), "key", "left")
    return both.agg(F.count("*").alias("stored"), F.count("hit").alias("matched")).withColumn("suspect", (F.col("stored") > 0) & (F.col("matched") * SUSPECT < F.col("stored")))


def _only_one(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.withColumn("_n", F.count("*").over(Window.partitionBy(*by))).where("_n = 1").drop("_n")


def _pairs(stale: DataFrame, fresh: DataFrame, by: list[str]) -> DataFrame:
    """old_key and new_key where both sides have one row for the same values."""
    return _only_one(stale, by).select(F.col("key").alias("old_key"), *by).join(_only_one(fresh, by).select(F.col("key").alias("new_key"), *by), by)


def pair_keys(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """Recorded keys that are no longer listed, with category and new key: `name`, `course`, `ambiguous` or `orphan`.

    recorded and current: (key, name, course). Keys pair by name where it is on either
    side once; names that are on both sides, but not once, pair by course within the name.
    """
    stale = recorded.join(current.select("key"), "key", "left_anti").select("key", "name", "course")
    fresh = current.join(recorded.select("key"), "key", "left_anti").select("key", "name", "course")
    by_name = _pairs(stale, fresh, ["name"]).select("old_key", "new_key", F.lit("name").alias("category"))
    left, free = stale.join(by_name.select(F.col("old_key").alias("key")), "key", "left_anti"), fresh.join(by_name.select(F.col("new_key").alias("key")), "key", "left_anti")
    by_course = _pairs(left.where("course is not null"), free.where("course is not null"), ["name", "course"]).select("old_key", "new_key", F.lit("course").alias("category"))
    rest = left.join(by_course.select(F.col("old_key").alias("key")), "key", "left_anti").join(free.select("name", F.lit(True).alias("named")).distinct(), "name", "left")
    others = rest.select(F.col("key").alias("old_key"), F.lit(None).cast("string").alias("new_key"), F.when(F.col("named"), "ambiguous").otherwise("orphan").alias("category"))
    return by_name.unionByName(by_course).unionByName(others)


def relocation(old_there: Column, new_there: Column, same: Column) -> Column:
    """What to do with a file whose place has changed: MOVE it, leave it for lack of room (LEFT), or nothing (NOOP)."""
    return F.when(same | ~old_there, "NOOP").when(new_there, "LEFT").otherwise("MOVE")


def relocations(files: DataFrame, existing: DataFrame) -> DataFrame:
    """files (key, old_path, new_path) with action: what relocation() says by the paths that exist (path), and unverified: whether it was left for lack of room."""
    there = existing.select("path").distinct()
    old = files.join(there.select(F.col("path").alias("old_path"), F.lit(True).alias("_old")), "old_path", "left")
    both = old.join(there.select(F.col("path").alias("new_path"), F.lit(True).alias("_new")), "new_path", "left")
    action = relocation(F.coalesce("_old", F.lit(False)), F.coalesce("_new", F.lit(False)), F.col("old_path").eqNullSafe(F.col("new_path")))
    return both.select("key", "old_path", "new_path", action.alias("action")).withColumn("unverified", F.col("action") == "LEFT")


def _keys(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_brand")
    name, course = F.concat_ws(" ", "p_name", (F.col("p_partkey") % 97).cast("string")), F.col("p_brand")
    old = parts.where("p_partkey % 11 <> 0").select(F.concat_ws("/", F.when(F.col("p_partkey") % 6 == 0, "same").otherwise("old"), "p_brand", "p_partkey").alias("key"), name.alias("name"), course.alias("course"))
    new = parts.where("p_partkey % 13 <> 0").select(F.concat_ws("/", F.when(F.col("p_partkey") % 6 == 0, "same").otherwise("new"), "p_brand", "p_partkey").alias("key"), name.alias("name"), course.alias("course"))
    return old, new


def migration_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each key that has gone moves to, if that is certain."""
    return pair_keys(*_keys(spark, sf_dir))


def migration_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys by category."""
    return migration_pairs(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n"), F.min("old_key").alias("first_key"))


def key_scheme(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether so few keys are found again that their scheme must have changed."""
    return scheme_changed(*_keys(spark, sf_dir))


_KEYS = """
    WITH parts AS (SELECT *, p_name || ' ' || (p_partkey % 97) AS name FROM part),
    old AS (SELECT (CASE WHEN p_partkey % 6 = 0 THEN 'same' ELSE 'old' END) || '/' || p_brand || '/' || p_partkey AS key, name, p_brand AS course FROM parts WHERE p_partkey % 11 <> 0),
    new AS (SELECT (CASE WHEN p_partkey % 6 = 0 THEN 'same' ELSE 'new' END) || '/' || p_brand || '/' || p_partkey AS key, name, p_brand AS course FROM parts WHERE p_partkey % 13 <> 0),
    stale AS (SELECT *, count(*) OVER (PARTITION BY name) AS n FROM old WHERE key NOT IN (SELECT key FROM new)),
    fresh AS (SELECT *, count(*) OVER (PARTITION BY name) AS n FROM new WHERE key NOT IN (SELECT key FROM old)),
    named AS (SELECT s.key AS old_key, f.key AS new_key FROM stale s JOIN fresh f USING (name) WHERE s.n = 1 AND f.n = 1),
    s2 AS (SELECT *, count(*) OVER (PARTITION BY name, course) AS m FROM stale WHERE key NOT IN (SELECT old_key FROM named)),
    f2 AS (SELECT *, count(*) OVER (PARTITION BY name, course) AS m FROM fresh WHERE key NOT IN (SELECT new_key FROM named)),
    coursed AS (SELECT s.key AS old_key, f.key AS new_key FROM s2 s JOIN f2 f USING (name, course) WHERE s.m = 1 AND f.m = 1),
    pairs AS (SELECT old_key, new_key, 'name' AS category FROM named UNION ALL SELECT old_key, new_key, 'course' FROM coursed
              UNION ALL SELECT key, NULL, CASE WHEN name IN (SELECT name FROM f2) THEN 'ambiguous' ELSE 'orphan' END FROM s2 WHERE key NOT IN (SELECT old_key FROM coursed))"""
QUERIES = {"migration_pairs": migration_pairs, "migration_report": migration_report, "key_scheme": key_scheme}
ORACLES = {
    "migration_pairs": f"{_KEYS} SELECT * FROM pairs",
    "migration_report": f"{_KEYS} SELECT category, count(*) AS n, min(old_key) AS first_key FROM pairs GROUP BY category",
    "key_scheme": f"{_KEYS} SELECT count(*) AS stored, count(*) FILTER (key IN (SELECT key FROM new)) AS matched, count(*) > 0 AND count(*) FILTER (key IN (SELECT key FROM new)) * 4 < count(*) AS suspect FROM old",
}
