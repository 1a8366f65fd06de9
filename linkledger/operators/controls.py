"""Queries over what pages' controls, groups and names say, what runs come to, and where files move."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import predicates as P
from ..functions import text as T
from ..functions import urls as U
from ..streaming import progress
from . import discovery as D
from . import migration as M
from . import redaction as R
from . import reports
from . import snapshots as S
from . import trees


def _of(values: list[str], k: Column) -> Column:
    """The value that a number's remainder names."""
    return F.get(F.array(*map(F.lit, values)), (k % len(values)).cast("int"))


def _sql_of(values: list[str], k: str) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][({k} % {len(values)})::INT + 1]"


TEXTS = ["Alle anzeigen", " SHOW  ALL ", "weiter", "", "view all"]
CLASSES = ["", "o pager-showAll", "o"]
TARGETS = ["/x?showall=1", "#", "javascript:f()", "/y", " #top "]


def page_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each supplier: whether its control lists all, where it leads, the tag of its file, and where clicks and answers go."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("k"))
    k, key = F.col("k"), F.col("k").cast("string")
    tag = F.concat(F.lit('<A id="i'), key, F.lit('" data-file-name="n&amp;'), key, F.lit('" href="/f/'), key, F.lit('">'))
    script = F.concat(F.lit('{"u":"/f","c":"e'), key, F.lit('","e":"focus"},{"u":"\\/click\\/'), key, F.lit('","c":"e'), key, F.lit('","x":1,'), F.when(k % 5 == 0, "").otherwise('"e":"click"'), F.lit('},{"u":"/z","c":"other","e":"click"}'))
    answer = F.concat(F.lit("<r>window.location='\\/to\\/"), key, F.lit("'</r>"))
    page = F.concat(F.lit('<a href="/o" data-file-name="n">o</a>'), tag, F.lit("x</A>"), script, F.when(k % 3 == 0, F.lit('"u":"\\/l?1-pager-showAllLink-x"')).otherwise(""))
    own = s.withColumn("page", page).withColumn("tag", H.anchor_for_file(F.col("page"), F.concat(F.lit("n&"), key)))
    target = _of(TARGETS, k)
    return own.select(
        "k",
        P.is_show_all(target, _of(TEXTS, k), F.lit(""), _of(CLASSES, k)).alias("shows_all"),
        P.leads_somewhere(target).alias("leads"),
        "tag",
        H.attribute(F.col("tag"), "href").alias("href"),
        H.click_url(F.col("page"), F.concat(F.lit("e"), key)).alias("click"),
        H.redirect_target(answer).alias("redirect"),
        H.show_all_url(F.col("page")).alias("list"),
        U.path_of(F.concat(F.when(k % 2 == 0, "https://h.example:81").otherwise(""), F.lit("/p%20q/"), key)).alias("path"),
        T.checksum_line(F.concat(F.when(k % 4 == 0, "x").otherwise(F.upper(F.sha2(key, 256))), F.lit("  setup.exe"))).alias("checksum"),
    )


def group_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups that a page for each nation lists in its second tree, its suppliers."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_name", "s_nationkey")
    k, key = F.col("s_suppkey"), F.col("s_suppkey").cast("string")
    node = F.struct(F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("<b>"), "s_name", F.lit("</b>&nbsp; A&amp;B"))).alias("text"), F.struct(F.concat(F.lit("/BusinessGroup/"), F.when(k % 5 == 0, "Overview").otherwise(key), F.lit("?x=1")).alias("href"), F.concat(F.lit("Group "), key).alias("title")).alias("a_attr"))
    pages = s.groupBy(F.col("s_nationkey").alias("nation")).agg(F.to_json(F.collect_list(node)).alias("nodes"))
    html = F.concat(F.lit('<script>var initial_data = [{"a_attr": {"href": "/CourseNode/1"}}]; var initial_data='), "nodes", F.lit(";</script>"))
    return trees.groups(pages.select("nation", html.alias("html")), "nation", "html").select("nation", "id", "url", "title")


WANTED = ["building ", " MACHINERY"]
FOLDERS = ["Downloads", " material ", ".git", "node_modules", "Algebra", "DL", "AppData"]
VERSIONS = ["", "dev", "1.2", "v3"]


def name_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which customers' segments are asked for, and what their folders, versions and requests are."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_mktsegment")
    k = F.col("c_custkey")
    kind, url = F.when(k % 3 == 0, "image").otherwise("document"), F.concat(F.lit("/auth/"), F.when(k % 2 == 0, "FolderResource/").otherwise("x/"), k.cast("string"))
    return c.select(
        "c_custkey",
        P.course_wanted(F.col("c_mktsegment"), WANTED).alias("wanted"),
        P.is_generic_folder(_of(FOLDERS, k)).alias("generic"),
        P.is_skipped_folder(_of(FOLDERS, k)).alias("skipped"),
        P.is_development_version(_of(VERSIONS, k)).alias("development"),
        P.is_preview(kind, k % 5 == 0, url).alias("preview"),
        P.is_empty_node(F.concat(F.lit("a  node-e"), F.when(k % 4 == 0, "n").otherwise("x"))).alias("empty_node"),
    )


def run_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each user's run came to, by its events: its outcome, whether all failed, whether a list stayed cut, and the share of errors as a verdict."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type", F.dayofmonth("ts").alias("day"))
    sums = e.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("day") <= 15).alias("before"), F.count_if(F.col("day") > 15).alias("after"))
    user, share = F.col("user_id"), 100.0 * F.col("errors") / F.col("n")
    return sums.select("user_id", reports.outcome(user % 11 == 0, user % 7 == 0, F.when(user % 2 == 0, 0).otherwise(F.col("errors"))).alias("outcome"), D.all_failed(F.col("n"), F.when(user % 5 == 0, F.col("n")).otherwise(F.col("errors"))).alias("all_failed"), D.truncated(F.col("before"), F.col("after")).alias("cut"), S.verdict(share * F.when(user % 3 == 0, 3).otherwise(1)).alias("verdict"))


def sheet_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where parts' files go since sheets have folders of their own, by what is there."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k"), "p_brand")
    name = F.concat(F.when(F.col("k") % 3 == 0, "Blatt_").otherwise("notes"), (F.col("k") % 40).cast("string"), F.lit("_"), F.col("k").cast("string"), F.lit(".pdf"))
    number = T.sheet_number(name)
    files = p.select(F.col("k").alias("key"), F.concat_ws("/", "p_brand", name).alias("old_path"), F.concat_ws("/", "p_brand", F.when(number.isNotNull(), T.fill_sheet(F.lit("{blatt}"), number)), name).alias("new_path"))
    there = files.where("key % 4 <> 0").select(F.col("old_path").alias("path")).unionByName(files.where("key % 5 = 0").select(F.col("new_path").alias("path")))
    return M.relocations(files, there).select("key", "action", "unverified", "new_path")


def scrubbed_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines of customers, with addresses, tokens and protected parts."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name")
    k, token = F.col("c_custkey"), F.sha2(F.col("c_custkey").cast("string"), 256)
    line = F.concat(F.lit("see https://h.example/"), token, F.lit("/a?t="), token, F.lit(" of "), "c_name", F.when(k % 3 == 0, F.concat(F.lit(" token "), token)).otherwise(""), F.when(k % 4 == 0, F.concat(F.lit(" in "), R.protect(F.concat(F.lit("/d/"), token)))).otherwise(""))
    return c.select("c_custkey", R.scrub(line).alias("line"))


def settled_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as repeated reads of something that grows; errors are failed reads."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.col("event_id").alias("seq"), F.when(F.col("event_type") != "error", F.floor(F.sqrt("value") / 3)).alias("n"))
    return progress.stable_read(e, "user_id", needed=4)


QUERIES = {f.__name__: f for f in (page_controls, group_listing, name_checks, run_verdicts, sheet_moves, scrubbed_logs, settled_reads)}
ORACLES = {
    "page_controls": f"""
        WITH s AS (SELECT s_suppkey AS k, lower(trim({_sql_of(TEXTS, "s_suppkey")})) AS t, lower({_sql_of(CLASSES, "s_suppkey")}) AS c, trim({_sql_of(TARGETS, "s_suppkey")}) AS u FROM supplier)
        SELECT k, contains(c, 'pager-showall') OR t IN ('alle anzeigen', 'view all') OR u = '/x?showall=1' AS shows_all, starts_with(u, '/') AS leads, '<A id="i' || k || '" data-file-name="n&amp;' || k || '" href="/f/' || k || '">' AS tag, '/f/' || k AS href,
               CASE WHEN k % 5 <> 0 THEN '/click/' || k END AS click, '/to/' || k AS redirect, CASE WHEN k % 3 = 0 THEN '/l?1-pager-showAllLink-x' ELSE '' END AS list, '/p%20q/' || k AS path, CASE WHEN k % 4 <> 0 THEN sha256(k::VARCHAR) END AS checksum FROM s""",
    "group_listing": """
        SELECT s_nationkey AS nation, s_suppkey::VARCHAR AS id, '/BusinessGroup/' || s_suppkey || '?x=1' AS url, CASE WHEN s_suppkey % 3 = 0 THEN 'Group ' || s_suppkey ELSE s_name || ' A&B' END AS title FROM supplier WHERE s_suppkey % 5 <> 0""",
    "name_checks": f"""
        SELECT c_custkey, lower(c_mktsegment) IN ('building', 'machinery') AS wanted, lower(trim({_sql_of(FOLDERS, "c_custkey")})) IN ('downloads', 'material', 'dl') AS generic, {_sql_of(FOLDERS, "c_custkey")} IN ('.git', 'node_modules', 'AppData') AS skipped,
               {_sql_of(VERSIONS, "c_custkey")} IN ('', 'dev') AS development, c_custkey % 3 <> 0 AND c_custkey % 5 <> 0 AND c_custkey % 2 = 0 AS preview, c_custkey % 4 = 0 AS empty_node FROM customer""",
    "run_verdicts": """
        WITH s AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (day(ts) <= 15) AS b, count(*) FILTER (day(ts) > 15) AS a FROM events GROUP BY 1),
        v AS (SELECT *, 100.0 * errors / n * CASE WHEN user_id % 3 = 0 THEN 3 ELSE 1 END AS share FROM s)
        SELECT user_id, CASE WHEN user_id % 11 = 0 THEN 'skipped' WHEN user_id % 7 = 0 THEN 'failure' WHEN user_id % 2 = 1 AND errors > 0 THEN 'partial' ELSE 'success' END AS outcome, user_id % 5 = 0 OR errors = n AS all_failed, b > 0 AND a <= b AS cut,
               CASE WHEN share > 50 THEN 'main cause' WHEN share >= 20 AND share <= 40 THEN 'part of it' WHEN share < 10 THEN 'no cause' ELSE 'unclear' END AS verdict FROM v""",
    "sheet_moves": """
        WITH f AS (SELECT p_partkey AS k, p_brand, CASE WHEN p_partkey % 3 = 0 THEN 'Blatt_' ELSE 'notes' END || p_partkey % 40 || '_' || p_partkey || '.pdf' AS name FROM part),
        g AS (SELECT k, p_brand || '/' || name AS old, p_brand || CASE WHEN k % 3 = 0 THEN '/Blatt' || lpad((k % 40)::VARCHAR, 2, '0') ELSE '' END || '/' || name AS new FROM f),
        a AS (SELECT *, CASE WHEN old = new OR NOT (k % 4 <> 0) THEN 'NOOP' WHEN k % 5 = 0 THEN 'LEFT' ELSE 'MOVE' END AS action FROM g)
        SELECT k AS key, action, action = 'LEFT' AS unverified, new AS new_path FROM a""",
    "scrubbed_logs": """
        WITH c AS (SELECT c_custkey AS k, c_name, sha256(c_custkey::VARCHAR) AS t FROM customer)
        SELECT k AS c_custkey, 'see https://h.example/' || t || '/a?... of ' || c_name || CASE WHEN k % 3 = 0 THEN ' token [redacted]' ELSE '' END || CASE WHEN k % 4 = 0 THEN ' in /d/' || t ELSE '' END AS line FROM c""",
    # read by read: the largest so far, how often in a row it came again, and how often it must
    "settled_reads": """
        WITH RECURSIVE r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth, CASE WHEN event_type <> 'error' THEN floor(sqrt(value) / 3)::BIGINT ELSE -1 END AS n FROM events),
        s AS (SELECT user_id, nth, n AS top, 0 AS streak, 4 AS asked FROM r WHERE nth = 1
              UNION ALL SELECT r.user_id, r.nth, greatest(r.n, s.top), CASE WHEN r.n >= 0 AND r.n = s.top THEN streak + 1 ELSE 0 END, asked + CASE WHEN s.top >= 0 AND r.n > s.top THEN 1 ELSE 0 END FROM s JOIN r ON r.user_id = s.user_id AND r.nth = s.nth + 1 WHERE s.streak < s.asked)
        SELECT user_id, arg_max(top, nth) AS best, max(nth)::INT AS polls, max(streak >= asked) AS settled FROM s GROUP BY 1""",
}
