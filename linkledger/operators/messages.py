"""Lines for people: progress, reports, failures, and a log cut to what an address can carry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from . import visits as V

#: Bytes that the address of a report may have, and exit codes by kind of failure.
BUDGET = 6500
EXIT_CODES = {"not_ready": 3, "already_running": 4, "offline": 5, "already_succeeded": 6}
HEAD = ["Course", "Section", "Visits", "Empty", "Notes"]


def progress(phase: Column, total: Column, nth: Column, course: Column, section: Column) -> Column:
    """A line for a step of a search."""
    where = F.when(total > 0, F.format_string("Scanning course %d of %d: %s", nth, total, course)).otherwise(F.concat(F.lit("Scanning course: "), course))
    return F.when(phase == "courses_found", F.format_string("Found %d course(s) - starting to scan them", total)).when(phase == "course_started", where).when((phase == "section") & (T.strip(section) != ""), F.concat(course, F.lit(": "), T.strip(section))).otherwise(course)


def padded(x: Column, width: int) -> Column:
    return F.when(F.length(x) < width, F.rpad(x, width, " ")).otherwise(x)


def report_lines(stats: DataFrame) -> DataFrame:
    """stats (of visits.section_stats) with a line for each section."""
    note = F.when(F.col("always_empty"), F.concat(F.format_string("empty on all %d visit(s)", "visits"), F.when(F.col("had_children"), " (container - files live in subsections)").otherwise(""))).when(F.col("empty_visits") > 0, F.format_string("empty on %d of %d visit(s)", "empty_visits", "visits")).otherwise("")
    line = F.concat_ws(" ", padded(T.shorten(F.col("course"), 30), 30), padded(T.shorten(F.col("section_title"), 35), 35), F.lpad(F.col("visits").cast("string"), 6, " "), F.lpad(F.col("empty_visits").cast("string"), 6, " "))
    return stats.withColumn("line", F.concat(line, F.lit("  "), note))


def exit_code(kind: Column) -> Column:
    """The exit code for a kind of failure; 1 for any other."""
    out = F.lit(1)
    for name, code in EXIT_CODES.items():
        out = F.when(kind == name, code).otherwise(out)
    return out


def network_state(own_site_answers: Column, others_answer: Column) -> Column:
    """Whether a site is reachable, or else the whole network is away."""
    return F.when(own_site_answers, "reachable").when(others_answer, "unreachable").otherwise("offline")


def fitting_lines(lines: DataFrame, key: str, number: str, text: str, fixed: int, budget: int = BUDGET) -> DataFrame:
    """The last lines of each key that an address of `budget` bytes can carry beside `fixed` bytes, in their escaped form.

    A running sum from the last line back; one line too many drops all before it.
    """
    size = F.octet_length(F.url_encode(F.col(text))) + 3
    back = Window.partitionBy(key).orderBy(F.desc(number)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("_sum", F.sum(size).over(back)).where(F.col("_sum") + fixed <= budget).drop("_sum")


def active_alert(status: DataFrame, dismissed: Column) -> DataFrame:
    """The latest status (timestamp, n, outcome), the larger number among equal times, if it is neither a success nor skipped nor dismissed."""
    latest = status.orderBy(F.desc("timestamp"), F.desc("n")).limit(1)
    return latest.where(~F.col("outcome").isin("success", "skipped") & ~F.coalesce(F.col("timestamp") == dismissed, F.lit(False)))


def active_alerts(status: DataFrame, key: str, dismissed: DataFrame) -> DataFrame:
    """active_alert of each key of status (key, timestamp, n, outcome), with the times that keys have dismissed (key, dismissed)."""
    latest = status.groupBy(key).agg(F.max_by(F.struct("timestamp", "n", "outcome"), F.struct("timestamp", "n")).alias("s")).select(key, "s.*")
    open_ = latest.join(dismissed.select(key, "dismissed").distinct(), (latest[key] == dismissed[key]) & (F.col("timestamp") == F.col("dismissed")), "left_anti")
    return open_.where(~F.col("outcome").isin("success", "skipped"))


def succeeded_on(status: DataFrame, day: Column, zone: str) -> DataFrame:
    """One row: whether a success was recorded on a calendar day of a zone."""
    return status.agg(F.coalesce(F.bool_or((F.col("outcome") == "success") & (F.to_date(F.from_utc_timestamp("timestamp", zone)) == day)), F.lit(False)).alias("succeeded"))


def visit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each section's line of the visit report."""
    return report_lines(V.visit_stats(spark, sf_dir)).select("course", "section_url", "line")


def log_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest events of each user whose properties fit into an address."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "props")
    return fitting_lines(e, "user_id", "event_id", "props", 100, 600).select("user_id", "event_id")


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "failure").when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "view", "skipped").otherwise("partial")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("timestamp"), kind.alias("outcome"), F.col("event_id").alias("n"))


def latest_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status that each user should see now; every fourth one has dismissed the last one."""
    status = _status(spark, sf_dir)
    dismissed = status.where("user_id % 4 = 0").groupBy("user_id").agg(F.max("timestamp").alias("dismissed"))
    return active_alerts(status, "user_id", dismissed).select("user_id", "n", "outcome")


def success_of_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a run succeeded on a day."""
    return succeeded_on(_status(spark, sf_dir), F.lit("2024-01-05").cast("date"), "UTC")


QUERIES = {"latest_alert": latest_alert, "success_of_day": success_of_day, "visit_report": visit_report, "log_budget": log_budget}
_STATUS = "SELECT user_id, ts, event_id AS n, CASE event_type WHEN 'error' THEN 'failure' WHEN 'purchase' THEN 'success' WHEN 'view' THEN 'skipped' ELSE 'partial' END AS outcome FROM events"
ORACLES = {
    "latest_alert": f"SELECT user_id, n, outcome FROM (SELECT * FROM ({_STATUS}) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, n DESC) = 1) WHERE outcome NOT IN ('success', 'skipped') AND user_id % 4 <> 0",
    "success_of_day": f"SELECT coalesce(bool_or(outcome = 'success' AND ts::DATE = DATE '2024-01-05'), false) AS succeeded FROM ({_STATUS})",
    "visit_report": V.ORACLES["visit_stats"].replace("SELECT course, section_url, count(*)", ", stats AS (SELECT course, section_url, count(*)", 1)
    + """) SELECT course, section_url, rpad(course, 30, ' ') || ' ' || rpad(section_title, 35, ' ') || ' ' || lpad(visits::VARCHAR, 6, ' ') || ' ' || lpad(empty_visits::VARCHAR, 6, ' ') || '  '
        || CASE WHEN always_empty THEN 'empty on all ' || visits || ' visit(s)' || CASE WHEN had_children THEN ' (container - files live in subsections)' ELSE '' END WHEN empty_visits > 0 THEN 'empty on ' || empty_visits || ' of ' || visits || ' visit(s)' ELSE '' END AS line FROM stats""",
    "log_budget": "SELECT user_id, event_id FROM (SELECT user_id, event_id, sum(strlen(replace(url_encode(props), '%20', '+')) + 3) OVER (PARTITION BY user_id ORDER BY event_id DESC ROWS UNBOUNDED PRECEDING) AS s FROM events) WHERE s + 100 <= 600",
}
