"""Merges of listings, and what runs tell of themselves: lookups by name, later rows over earlier ones, replays, stalls and pacing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import predicates as P
from ..functions import text as T
from ..sources.tables import in_order
from . import addresses as A

#: Files of a section from which it is fetched as a whole, seconds without progress that are a stall, seconds
#: between its warnings, and milliseconds between requests.
LEAST_GROUP, STALL_SECONDS, EVERY, SPACING = 2, 180, 30, 250


def bulk_lookup(jobs: DataFrame, entries: DataFrame, least: int = LEAST_GROUP) -> DataFrame:
    """jobs (section_url, path) with the archive entry (section_url, name, modified) of their base name, and whether they are done by it.

    Only sections of `least` jobs or more are fetched as archives; all other jobs, and names
    that the archive lacks, stay for a fetch of their own.
    """
    size = jobs.groupBy("section_url").agg((F.count("*") >= least).alias("_bulk"))
    named = jobs.withColumn("name", F.regexp_extract("path", "([^/]*)$", 1)).join(size, "section_url")
    found = named.join(entries.select("section_url", "name", "modified", F.lit(True).alias("_found")), ["section_url", "name"], "left")
    done = F.col("_bulk") & F.col("_found").isNotNull()
    return found.select("section_url", "path", F.when(done, F.col("modified")).alias("modified"), done.alias("done"))


def later_wins(frames: list[DataFrame], key: list[str]) -> DataFrame:
    """The union of frames with equal columns; of rows with one key, that of the last frame that has it."""
    both = None
    for n, frame in enumerate(frames):
        one = frame.withColumn("_from", F.lit(n))
        both = one if both is None else both.unionByName(one)
    rest = [c for c in frames[0].columns if c not in key]
    return both.groupBy(*key).agg(F.max_by(F.struct(*rest), "_from").alias("_row")).select(*key, "_row.*")


def course_rows(wanted: DataFrame, folders: DataFrame) -> DataFrame:
    """(place, name, folder): the wanted courses (place, name) with their folders, then the other keys of folders (name, folder) in order.

    A list of just * asks for all courses and stands for none of its own.
    """
    named = wanted.where(F.trim("name") != "*")
    listed = named.join(folders, "name", "left").select("place", "name", F.coalesce("folder", F.lit("")).alias("folder"))
    rest = in_order(folders.join(named, "name", "left_anti"), ["name"], "nth").select("nth", "name", "folder")
    after = listed.agg(F.coalesce(F.max("place") + 1, F.lit(0)).alias("after"))
    return listed.unionByName(rest.join(after).select((F.col("after") + F.col("nth")).alias("place"), "name", "folder"))


def run_stats(outcomes: DataFrame, key: str) -> DataFrame:
    """Downloaded, skipped, failed and waiting entries of each key's outcomes (status, error)."""
    n = lambda c: F.count_if(c).alias
    bad = F.col("error").isNotNull()
    return outcomes.groupBy(key).agg(n(~bad & (F.col("status") == "changed"))("downloaded"), n(~bad & (F.col("status") == "unchanged"))("skipped"), n(bad)("errors"), n(~bad & (F.col("status") == "waiting"))("backing_off"))


def paced(requests: DataFrame, key: str, at: str, order: str, spacing: int = SPACING) -> DataFrame:
    """requests with `sent`, in milliseconds, no two of a key nearer than `spacing`, and `held`: how long each was held back.

    A request goes out at its own time or `spacing` after the one before it. Counted back by
    its place, that is a running maximum, so no state has to be carried from row to row. The
    longer pauses that answers of 429 or 503 would ask for aren't added.
    """
    turn = Window.partitionBy(key).orderBy(at, order)
    ahead = (F.row_number().over(turn) - 1) * spacing
    numbered = requests.withColumn("_ahead", ahead)
    sent = F.max(F.col(at) - F.col("_ahead")).over(turn.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("_ahead")
    return numbered.withColumn("sent", sent).withColumn("held", F.col("sent") - F.col(at)).drop("_ahead")


def limiter_stats(sent: DataFrame, key: str) -> DataFrame:
    """Waits, delayed ones and the time held of each key's paced requests, and its answers that ask to slow down, which are only counted."""
    return sent.groupBy(key).agg(F.count("*").alias("waits"), F.count_if(F.col("held") > 0).alias("delayed"), F.sum("held").alias("held"), F.count_if(F.col("status").isin(429, 503)).alias("busy"))


def numbered(events: DataFrame, job: str, order: list[str]) -> DataFrame:
    """A job's events as its log has them: with seq, from 1 in the order of publication."""
    return events.withColumn("seq", F.row_number().over(Window.partitionBy(job).orderBy(*order)).cast("long"))


def replay(log: DataFrame, viewers: DataFrame, job: str) -> DataFrame:
    """What each viewer (viewer, job, seen) of a log gets on connecting: all events after the last one it saw. None is dropped."""
    return viewers.join(log, job).where(F.col("seq") > F.coalesce("seen", F.lit(0)))


def without_shared(rows: DataFrame, key: str, shared: str) -> tuple[DataFrame, DataFrame]:
    """rows without a text that all rows of a key share, and the table (key, shared) that has it once."""
    return rows.drop(shared), rows.groupBy(key).agg(F.max(shared).alias(shared))


def with_shared(rows: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """What without_shared took apart."""
    return rows.join(texts, key, "left")


def first_success(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """jobs (key, source, show_all, expanded) with the first of their pages that results (url, ok) tell to work, null if none, and how many were tried.

    The source is tried even if it is blank, the others only if they aren't; pages that differ
    in case alone are one.
    """
    told = lambda x: F.lower(T.strip(F.coalesce(x, F.lit(""))))
    pages = F.array_distinct(F.concat(F.array(told(F.col("source"))), F.filter(F.array(told(F.col("show_all")), told(F.col("expanded"))), lambda p: p != "")))
    each = jobs.select("key", F.posexplode(pages).alias("nth", "url")).join(results.groupBy(told(F.col("url")).alias("url")).agg(F.bool_or("ok").alias("ok")), "url", "left")
    first = F.min(F.when(F.coalesce("ok", F.lit(False)), F.struct("nth", "url")))
    return each.groupBy("key").agg(first.alias("first"), F.count("*").alias("n")).select("key", F.col("first.url").alias("page"), F.coalesce(F.col("first.nth") + 1, F.col("n")).cast("long").alias("tried"))


def stall_warnings(events: DataFrame, key: str, order: str, until: Column) -> DataFrame:
    """(key, last, n, quiet): a warning after STALL_SECONDS without events of a key, and another one EVERY seconds until the next event or `until`.

    events: (key, at in seconds, order). `last` is the event before the silence; `quiet` the seconds so far.
    """
    next_ = F.coalesce(F.lead("at").over(Window.partitionBy(key).orderBy("at", order)), until)
    quiet = events.select(key, F.col("at").alias("last"), (next_ - F.col("at")).alias("quiet")).where(F.col("quiet") >= STALL_SECONDS)
    each = F.posexplode(F.sequence(F.lit(STALL_SECONDS).cast("long"), F.col("quiet"), F.lit(EVERY).cast("long"))).alias("n", "quiet")
    return quiet.select(key, "last", each).select(key, "last", (F.col("n") + 1).alias("n"), "quiet")


# Lines, parts and events stand for jobs, listings and requests.


def bulk_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as files of their orders' sections; three of four are in the archive."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    jobs = lines.select(F.col("l_orderkey").alias("section_url"), F.concat_ws("/", F.lit("a"), "l_orderkey", F.concat(F.lit("f"), "l_linenumber", F.lit("-"), "l_partkey")).alias("path"))
    entries = lines.where("l_partkey % 4 <> 0").select(F.col("l_orderkey").alias("section_url"), F.concat(F.lit("f"), "l_linenumber", F.lit("-"), "l_partkey").alias("name"), F.col("l_shipdate").cast("date").cast("string").alias("modified"))
    return bulk_lookup(jobs.distinct(), entries.groupBy("section_url", "name").agg(F.max("modified").alias("modified")))


def merged_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of three sources by address: brands of parts, their suppliers' nations, and large parts."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("string").alias("url"), "p_brand", "p_type", "p_size")
    one = lambda where, title: parts.where(where).select("url", title.alias("title"))
    return later_wins([one("true", F.col("p_brand")), one("p_size % 3 = 0", F.col("p_type")), one("p_size > 25", F.concat(F.lit("size "), "p_size"))], ["url"])


def settings_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of some segments as wanted courses, and folders for others too."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name")
    wanted = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("place"), F.col("c_name").alias("name"))
    folders = c.where("c_custkey % 3 <> 0 or c_custkey % 2 = 0").select(F.col("c_name").alias("name"), F.concat(F.lit("folder "), "c_custkey").alias("folder"))
    return course_rows(wanted, folders)


def run_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as outcomes of their users' runs."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type")
    status = F.when(F.col("event_type") == "view", "unchanged").when(F.col("event_type") == "click", "waiting").otherwise("changed")
    return run_stats(e.select("user_id", status.alias("status"), F.when(F.col("event_type") == "error", F.lit("failed")).alias("error")), "user_id")


def request_pacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests, a thousand times as dense, by kind: how often and how long pacing holds them."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "event_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long").alias("at"), F.when(F.col("event_id") % 9 == 0, 503).otherwise(200).alias("status"))
    return limiter_stats(paced(e, "event_type", "at", "event_id"), "event_type")


def event_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What viewers of each user's events still get: one who is new, and one who saw the first three."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "ts")
    log = numbered(e, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "seq")
    users = e.select("user_id").distinct()
    viewers = users.select("user_id", F.lit("new").alias("viewer"), F.lit(None).cast("long").alias("seen")).unionByName(users.select("user_id", F.lit("known").alias("viewer"), F.lit(3).cast("long").alias("seen")))
    return replay(log, viewers, "user_id").select("viewer", "user_id", "seq", "event_id")


def stalled_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings of kinds of events that stay quiet, hours being told as seconds, up to the end of the month."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000).cast("long").alias("at"))
    return stall_warnings(e, "user_id", "event_id", F.lit(1706745600 // 60).cast("long"))


def file_shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many links of each course look like files."""
    links = A.customer_links(spark, sf_dir)
    return links.groupBy("course").agg(F.count_if(P.is_file(F.col("href"), F.col("title"))).alias("n_files"), F.count_distinct("href").alias("n_addresses"))


def shared_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines whose order's priority was taken out of them and put back."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderpriority")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey").join(orders, "o_orderkey")
    rows, texts = without_shared(lines, "o_orderkey", "o_orderpriority")
    return with_shared(rows, texts, "o_orderkey")


def fallback_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' pages in the order in which they are tried, of which suppliers tell some to work."""
    c, s = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey"), spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey")
    k = F.col("c_custkey")
    jobs = c.select(k.alias("key"), F.when(k % 5 != 0, F.concat(F.lit("/P"), k % 40)).alias("source"), F.when(k % 3 == 0, F.concat(F.lit(" /p"), k % 40)).otherwise(F.concat(F.lit("/q"), k % 50)).alias("show_all"), F.when(k % 2 == 0, F.concat(F.lit("/r"), k % 30)).otherwise(" ").alias("expanded"))
    front = F.get(F.array(F.lit("/p"), F.lit("/Q"), F.lit("/r")), (F.col("s_suppkey") % 3).cast("int"))
    return first_success(jobs, s.select(F.concat(front, F.col("s_suppkey")).alias("url"), (F.col("s_suppkey") % 4 != 1).alias("ok")))


QUERIES = {f.__name__: f for f in (shared_texts, fallback_pages, bulk_jobs, merged_candidates, settings_rows, run_outcomes, request_pacing, event_replay, stalled_runs, file_shaped)}
ORACLES = {
    "shared_texts": "SELECT l_orderkey AS o_orderkey, l_linenumber, l_partkey, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "fallback_pages": """
        WITH j AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 5 <> 0 THEN '/p' || c_custkey % 40 ELSE '' END AS a, CASE WHEN c_custkey % 3 = 0 THEN '/p' || c_custkey % 40 ELSE '/q' || c_custkey % 50 END AS b, CASE WHEN c_custkey % 2 = 0 THEN '/r' || c_custkey % 30 END AS c FROM customer),
        r AS (SELECT ['/p', '/q', '/r'][(s_suppkey % 3)::INT + 1] || s_suppkey AS url FROM supplier WHERE s_suppkey % 4 <> 1),
        k AS (SELECT key, a, CASE WHEN b <> a THEN b END AS b, c FROM j), o AS (SELECT *, a IN (FROM r) AS oa, coalesce(b IN (FROM r), false) AS ob, coalesce(c IN (FROM r), false) AS oc FROM k)
        SELECT key, CASE WHEN oa THEN a WHEN ob THEN b WHEN oc THEN c END AS page, (CASE WHEN oa THEN 1 WHEN ob THEN 2 ELSE 1 + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT END)::BIGINT AS tried FROM o""",
    "bulk_jobs": """
        WITH d AS (SELECT l_orderkey, l_linenumber, l_partkey, max(l_shipdate)::DATE::VARCHAR AS day FROM lineitem GROUP BY 1, 2, 3),
        j AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey) >= 2 AND l_partkey % 4 <> 0 AS done FROM d)
        SELECT l_orderkey AS section_url, 'a/' || l_orderkey || '/f' || l_linenumber || '-' || l_partkey AS path, CASE WHEN done THEN day END AS modified, done FROM j""",
    "merged_candidates": "SELECT p_partkey::VARCHAR AS url, CASE WHEN p_size > 25 THEN 'size ' || p_size WHEN p_size % 3 = 0 THEN p_type ELSE p_brand END AS title FROM part",
    "settings_rows": """
        WITH f AS (SELECT c_name AS name, 'folder ' || c_custkey AS folder, c_custkey FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0), w AS (SELECT c_custkey AS place, c_name AS name FROM customer WHERE c_custkey % 3 = 0)
        SELECT place, name, coalesce(folder, '') AS folder FROM w LEFT JOIN f USING (name)
        UNION ALL SELECT (SELECT max(place) FROM w) + row_number() OVER (ORDER BY name), name, folder FROM f WHERE c_custkey % 3 <> 0""",
    "run_outcomes": """SELECT user_id, count(*) FILTER (event_type NOT IN ('view', 'click', 'error')) AS downloaded, count(*) FILTER (event_type = 'view') AS skipped, count(*) FILTER (event_type = 'error') AS errors,
        count(*) FILTER (event_type = 'click') AS backing_off FROM events GROUP BY 1""",
    "request_pacing": """
        WITH RECURSIVE r AS (SELECT event_type, epoch_us(ts) // 1000000 AS t, event_id % 9 = 0 AS busy, row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts) // 1000000, event_id) AS nth FROM events),
        s AS (SELECT event_type, nth, t, t AS sent, busy FROM r WHERE nth = 1 UNION ALL SELECT r.event_type, r.nth, r.t, greatest(r.t, s.sent + 250), r.busy FROM s JOIN r ON r.event_type = s.event_type AND r.nth = s.nth + 1)
        SELECT event_type, count(*) AS waits, count(*) FILTER (sent > t) AS delayed, sum(sent - t)::BIGINT AS held, count(*) FILTER (busy) AS busy FROM s GROUP BY 1""",
    "event_replay": """
        WITH l AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events)
        SELECT 'new' AS viewer, user_id, seq, event_id FROM l UNION ALL SELECT 'known', user_id, seq, event_id FROM l WHERE seq > 3""",
    "stalled_runs": """
        WITH e AS (SELECT user_id, event_id, epoch_us(ts) // 60000000 AS t FROM events), g AS (SELECT user_id, t, coalesce(lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id), 28445760) - t AS quiet FROM e)
        SELECT user_id, t AS last, unnest(range(0, (quiet - 180) // 30 + 1))::INT + 1 AS n, 180 + 30 * unnest(range(0, (quiet - 180) // 30 + 1)) AS quiet FROM g WHERE quiet >= 180""",
    "file_shaped": A.ORACLES["link_kinds"].replace("SELECT k, t <> ''", ", q AS (SELECT course, href, t <> ''", 1) + ") SELECT course, count(*) FILTER (is_file) AS n_files, count(DISTINCT href) AS n_addresses FROM q GROUP BY 1",
}
