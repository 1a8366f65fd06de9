"""Statistics of visits: by section, by run, and of one run against another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A longer gap than this begins a new run.
GAP_SECONDS = 180


def section_stats(visits: DataFrame) -> DataFrame:
    """(course, section_url) of visits (course, section_title, section_url, files_found, ts, had_children) with counts.

    The title is the latest one that isn't blank; titles that share a time go by code point.
    """
    titled = F.struct("ts", "section_title")
    shown = F.max(F.when(F.trim("section_title") != "", titled))["section_title"]
    stats = visits.groupBy("course", "section_url").agg(
        F.count("*").alias("visits"),
        F.count_if(F.col("files_found") == 0).alias("empty_visits"),
        F.max("ts").alias("last_visited"),
        F.coalesce(shown, F.lit("")).alias("section_title"),
        F.bool_or(F.coalesce("had_children", F.lit(False))).alias("had_children"),
    )
    return stats.withColumn("always_empty", F.col("empty_visits") == F.col("visits"))


def report_order() -> list[Column]:
    """Sections that were always empty first, then by empty visits, visits, course and title."""
    return [F.desc("always_empty"), F.desc("empty_visits"), F.desc("visits"), F.col("course").asc(), F.col("section_title").asc()]


def runs(visits: DataFrame, partition: list[str], ts: str = "ts", gap: int = GAP_SECONDS) -> DataFrame:
    """visits with run, numbered from 1 in each partition: a gap of more than `gap` seconds begins a new one."""
    order = Window.partitionBy(*partition).orderBy(ts)
    micros = F.timestamp_diff("MICROSECOND", F.lag(ts).over(order), F.col(ts))
    new = F.when(micros.isNull() | (micros > gap * 1_000_000), 1).otherwise(0)
    return visits.withColumn("_new", new).withColumn("run", F.sum("_new").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))).drop("_new")


def run_difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """(section_url, files_before, files_after, change): NEW, GONE, CHANGED or SAME."""
    both = before.select("section_url", F.col("files").alias("files_before")).join(after.select("section_url", F.col("files").alias("files_after")), "section_url", "full")
    change = F.when(F.col("files_before").isNull(), "NEW").when(F.col("files_after").isNull(), "GONE").when(F.col("files_before") != F.col("files_after"), "CHANGED").otherwise("SAME")
    return both.withColumn("change", change)


# Events stand for visits: their type is the course, the user is the section, and an error found no files.


def _visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.when(F.col("value") < 20, 0).otherwise(F.floor("value")).cast("int")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("course"), F.when(F.col("event_id") % 6 == 0, " ").otherwise(F.concat(F.lit("Section "), F.col("event_id") % 4)).alias("section_title"), F.col("user_id").cast("string").alias("section_url"), found.alias("files_found"), "ts", (F.col("event_id") % 17 == 0).alias("had_children"))


def visit_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each section was visited, and how often it had nothing."""
    return section_stats(_visits(spark, sf_dir)).orderBy(*report_order())


def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each section's runs with their visits, files and courses."""
    runs_ = runs(_visits(spark, sf_dir), ["section_url"], gap=6 * 3600)
    return runs_.groupBy("section_url", "run").agg(F.count("*").alias("visits"), F.sum("files_found").alias("files"), F.count_distinct("course").alias("courses"), F.min("ts").alias("began"))


def run_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of each section in the first half of the month against the second; some sections get other addresses in between."""
    visits = _visits(spark, sf_dir).withColumn("late", F.dayofmonth("ts") > 15)
    visits = visits.withColumn("section_url", F.concat("section_url", F.when(F.col("late") & F.expr("section_url % 5 = 0"), "-new").when(~F.col("late") & F.expr("section_url % 3 = 0"), "-old").otherwise("")))
    files = lambda late: visits.where(F.col("late") == late).groupBy("section_url").agg(F.sum("files_found").alias("files"))
    return run_difference(files(False), files(True))


_VISITS = """
    WITH visits AS (SELECT event_type AS course, CASE WHEN event_id % 6 = 0 THEN ' ' ELSE 'Section ' || (event_id % 4) END AS section_title, user_id::VARCHAR AS section_url,
                           CASE WHEN value < 20 THEN 0 ELSE floor(value) END::INT AS files_found, ts, event_id % 17 = 0 AS had_children FROM events)"""
QUERIES = {"visit_stats": visit_stats, "run_totals": run_totals, "run_diff": run_diff}
ORACLES = {
    "visit_stats": f"""{_VISITS} SELECT course, section_url, count(*) AS visits, count(*) FILTER (files_found = 0) AS empty_visits, max(ts) AS last_visited,
               coalesce(max({{'ts': ts, 't': section_title}}) FILTER (trim(section_title) <> '').t, '') AS section_title, bool_or(had_children) AS had_children, count(*) FILTER (files_found = 0) = count(*) AS always_empty
        FROM visits GROUP BY course, section_url""".replace("max({'ts': ts, 't': section_title}) FILTER (trim(section_title) <> '').t", "(max({'ts': ts, 't': section_title}) FILTER (trim(section_title) <> '')).t"),
    "run_totals": f"""{_VISITS}, marked AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM visits WINDOW w AS (PARTITION BY section_url ORDER BY ts)),
        numbered AS (SELECT *, sum(new) OVER (PARTITION BY section_url ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM marked)
        SELECT section_url, run::BIGINT AS run, count(*) AS visits, sum(files_found)::BIGINT AS files, count(DISTINCT course) AS courses, min(ts) AS began FROM numbered GROUP BY section_url, run""",
    "run_diff": f"""{_VISITS}, named AS (SELECT section_url || CASE WHEN day(ts) > 15 AND section_url::INT % 5 = 0 THEN '-new' WHEN day(ts) <= 15 AND section_url::INT % 3 = 0 THEN '-old' ELSE '' END AS section_url, day(ts) > 15 AS late, files_found FROM visits),
        halves AS (SELECT section_url, late, sum(files_found)::BIGINT AS files FROM named GROUP BY ALL)
        SELECT coalesce(a.section_url, b.section_url) AS section_url, a.files AS files_before, b.files AS files_after,
               CASE WHEN a.files IS NULL THEN 'NEW' WHEN b.files IS NULL THEN 'GONE' WHEN a.files <> b.files THEN 'CHANGED' ELSE 'SAME' END AS change
        FROM (SELECT * FROM halves WHERE NOT late) a FULL JOIN (SELECT * FROM halves WHERE late) b USING (section_url)""",
}
