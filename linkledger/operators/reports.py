"""Aggregates of runs: counts, checks against a baseline, timings, throughput and histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import ranges

#: Percent that a total may drop, history rows, log lines, and log lines in a report.
DROP_PERCENT, HISTORY, LOG_LINES, REPORT_LINES = 20.0, 30, 400, 60


def counts_with_empty(groups: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows of each group, groups without any included."""
    return groups.select(key).distinct().join(rows.groupBy(key).agg(F.count("*").alias("n")), key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def baseline_series(totals: DataFrame, order: str, total: str, threshold: float = DROP_PERCENT) -> DataFrame:
    """Totals run by run against a baseline that only rises: baseline, drop_percent and verdict.

    With nothing before it a run establishes the baseline. Nothing found, or a drop by
    more than the threshold, fails and leaves the baseline; a smaller drop passes and
    leaves it too; so it is the largest total so far: that of the rows before in a row's
    range of the order, and of all ranges before, of each of which one number is gathered.
    """
    placed = ranges(totals, [order])
    earlier = F.max("_most").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    heads = placed.groupBy("_part").agg(F.max(total).alias("_most")).select("_part", earlier.alias("_earlier"))
    inside = F.max(total).over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    drop = F.when(F.col(total) < F.col("baseline"), 100.0 * (F.col("baseline") - F.col(total)) / F.col("baseline")).otherwise(0.0)
    verdict = F.when(F.col("baseline").isNull(), "established").when(F.col(total) == 0, "failed").when(F.col("drop_percent") > threshold, "failed").otherwise("passed")
    known = placed.join(F.broadcast(heads), "_part").withColumn("baseline", F.greatest(inside, "_earlier")).drop("_part", "_earlier")
    return known.withColumn("drop_percent", drop).withColumn("verdict", verdict)


def breakdown(rows: DataFrame, step: str, total: str, waited: str) -> DataFrame:
    """Each step's count, total, wait, average and share of all."""
    sums = rows.groupBy(step).agg(F.count("*").alias("n"), F.sum(total).alias("total"), F.sum(waited).alias("waited"))
    return sums.withColumn("average", F.col("total") / F.col("n")).withColumn("share", F.try_divide(F.col("total"), F.sum("total").over(Window.partitionBy(F.lit(0)))))


def throughput(n: Column, size: Column, elapsed: Column, wall: Column) -> list[Column]:
    """Files, bytes of known size, mean seconds of a file, files and MB (of 1024 * 1024 bytes) a second of wall clock; 0 in no time."""
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return [n.alias("files"), F.coalesce(size, F.lit(0)).alias("bytes"), zero(F.try_divide(elapsed, n)).alias("average_s"), zero(F.try_divide(n.cast("double"), wall)).alias("files_s"), zero(F.try_divide(size / (1 << 20), wall)).alias("mb_s")]


def outcome(held: Column, failed: Column, errors: Column) -> Column:
    """What became of a run."""
    return F.when(held, "skipped").when(failed, "failure").when(errors > 0, "partial").otherwise("success")


def last_rows(rows: DataFrame, order: list[Column], n: int, by: list[str] | None = None) -> DataFrame:
    """The first n rows in an order, of each group if any."""
    if not by:
        return rows.orderBy(*order).limit(n)
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_nth") <= n).drop("_nth")


def set_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows by keys that only one side has: side is `missing` (left only) or `extra` (right only). Groups that left lacks count too."""
    a, b = left.select(keys).distinct(), right.select(keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, keys, "left_anti").withColumn("side", F.lit("extra")))


def pearson(x: Column, y: Column) -> Column:
    """The correlation; 0 for fewer than two rows or without variance."""
    return F.coalesce(F.nanvl(F.corr(x, y), F.lit(0.0)), F.lit(0.0))




def quartet(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Least, upper median and largest value of each group, by ranks."""
    w = Window.partitionBy(group)
    ranked = rows.where(F.col(value).isNotNull()).select(group, value, F.row_number().over(w.orderBy(value)).alias("_nth"), F.count("*").over(w).alias("_n"))
    return ranked.groupBy(group).agg(F.first("_n").alias("n"), F.min(value).alias("least"), F.max(F.when(F.col("_nth") == F.floor(F.col("_n") / 2) + 1, F.col(value))).alias("median"), F.max(value).alias("largest"))


def completeness(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Of each column, how many rows have a value that isn't blank."""
    has = lambda c: F.count_if(F.trim(F.col(c).cast("string")) != "").alias(c)
    wide = rows.agg(F.count("*").alias("n_rows"), *map(has, columns))
    pairs = F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("filled")) for c in columns))
    return wide.select("n_rows", F.explode(pairs).alias("c")).select("c.name", "c.filled", (F.col("n_rows") - F.col("c.filled")).alias("empty"))


def course_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each customer, none included."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return counts_with_empty(read("customer").select(F.col("c_custkey").alias("key")), read("orders").select(F.col("o_custkey").alias("key")), "key")


def baseline_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases of each day against the largest day before."""
    days = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count_if(F.col("event_type") == "purchase").alias("total"))
    return baseline_series(days, "day", "total")


def phase_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities by line status, as steps of a run."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.concat("l_returnflag", "l_linestatus").alias("step"), F.col("l_quantity").cast("long").alias("total"), F.col("l_linenumber").cast("long").alias("waited"))
    return breakdown(lines, "step", "total", "waited")


def run_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's lines as downloads: known sizes, seconds, and speed by wall clock."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", F.when(F.col("l_linenumber") % 4 != 0, F.floor("l_extendedprice").cast("long")).alias("size"), F.col("l_quantity").alias("seconds"))
    sums = lines.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.sum("seconds").alias("elapsed"), F.max("seconds").alias("wall"))
    return sums.select("l_suppkey", *throughput(F.col("n"), F.col("size"), F.col("elapsed"), F.col("wall")))


def history_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest events of each user, as a bounded history."""
    return last_rows(spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "ts"), [F.desc("ts"), F.desc("event_id")], HISTORY, ["user_id"])


def set_diff_by_course(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users and hours of each kind of event that only one half of the month has."""
    name = F.concat_ws("@", "user_id", F.hour("ts"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("course"), name.alias("name"), F.dayofmonth("ts").alias("day"))
    return set_difference(events.where("day <= 15"), events.where("day > 15"), ["course", "name"])


def correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity against price, and squared, by return flag."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("square", F.col("l_quantity") * F.col("l_quantity"))
    return lines.groupBy("l_returnflag").agg(F.round(pearson(F.col("l_quantity"), F.col("l_extendedprice")), 9).alias("r"), F.round(pearson(F.col("square"), F.col("l_extendedprice")), 9).alias("r_square"))


def size_quartet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least, median and largest price of each supplier's lines."""
    return quartet(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_suppkey", "l_extendedprice")


def column_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filled values of the documents' columns."""
    return completeness(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id", "text", "lang", "source", "n_chars"])


def content_hash_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents that several documents have, by hash."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.sha2("text", 256).alias("hash"))
    return docs.groupBy("hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc_id")).where("n > 1")


QUERIES = {f.__name__: f for f in (course_counts, baseline_check, phase_breakdown, history_tail, set_diff_by_course, correlation, size_quartet, column_completeness, content_hash_dups)} | {"throughput": run_throughput}
ORACLES = {
    "course_counts": "SELECT c_custkey AS key, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
    "baseline_check": """
        WITH days AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (event_type = 'purchase') AS total FROM events GROUP BY 1),
        based AS (SELECT *, max(total) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS baseline FROM days),
        dropped AS (SELECT *, CASE WHEN total < baseline THEN 100.0::DOUBLE * (baseline - total) / baseline ELSE 0.0::DOUBLE END AS drop_percent FROM based)
        SELECT day, total, baseline, drop_percent, CASE WHEN baseline IS NULL THEN 'established' WHEN total = 0 OR drop_percent > 20 THEN 'failed' ELSE 'passed' END AS verdict FROM dropped""",
    "phase_breakdown": """SELECT l_returnflag || l_linestatus AS step, count(*) AS n, sum(l_quantity::BIGINT)::BIGINT AS total, sum(l_linenumber)::BIGINT AS waited, sum(l_quantity::BIGINT)::DOUBLE / count(*) AS average,
        sum(l_quantity::BIGINT)::DOUBLE / (SELECT sum(l_quantity::BIGINT) FROM lineitem) AS share FROM lineitem GROUP BY 1""",
    "history_tail": "SELECT user_id, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 30",
    "set_diff_by_course": """
        WITH e AS (SELECT event_type AS course, user_id || '@' || hour(ts) AS name, day(ts) AS day FROM events), a AS (SELECT DISTINCT course, name FROM e WHERE day <= 15), b AS (SELECT DISTINCT course, name FROM e WHERE day > 15)
        SELECT *, 'missing' AS side FROM (FROM a EXCEPT FROM b) UNION ALL SELECT *, 'extra' FROM (FROM b EXCEPT FROM a)""",
    "correlation": "SELECT l_returnflag, round(coalesce(corr(l_quantity, l_extendedprice), 0), 9) AS r, round(coalesce(corr(l_quantity * l_quantity, l_extendedprice), 0), 9) AS r_square FROM lineitem GROUP BY 1",
    "size_quartet": "SELECT l_suppkey, count(*) AS n, min(l_extendedprice) AS least, (list_sort(list(l_extendedprice)))[count(*) // 2 + 1] AS median, max(l_extendedprice) AS largest FROM lineitem GROUP BY 1",
    "column_completeness": " UNION ALL ".join(f"SELECT '{c}' AS name, count(*) FILTER (trim({c}::VARCHAR) <> '') AS filled, count(*) FILTER (coalesce(trim({c}::VARCHAR), '') = '') AS empty FROM documents" for c in ("doc_id", "text", "lang", "source", "n_chars")),
    "content_hash_dups": "SELECT sha256(text) AS hash, count(*) AS n, min(doc_id) AS first_doc_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "throughput": """
        WITH s AS (SELECT l_suppkey, count(*) AS files, coalesce(sum(CASE WHEN l_linenumber % 4 <> 0 THEN floor(l_extendedprice)::BIGINT END), 0)::BIGINT AS bytes, sum(l_quantity) AS elapsed, max(l_quantity) AS wall FROM lineitem GROUP BY 1)
        SELECT l_suppkey, files, bytes, elapsed / files AS average_s, files::DOUBLE / wall AS files_s, bytes / 1048576.0::DOUBLE / wall AS mb_s FROM s""",
}
