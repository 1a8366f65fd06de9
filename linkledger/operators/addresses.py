"""Queries that judge and name links: suppliers and customers stand for the links of course pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as T
from ..functions import urls as U
from ..plans import listing as L

BASE = "https://h.example"
#: Suppliers whose pages one task makes and searches, about.
PAGES = 5000
#: Addresses by the remainder of a link's number; {k} is the number, {n} its nation.
SHAPES = [
    "/auth/RepositoryEntry/{n}/CourseNode/{k}/A%20B/",
    "/auth/RepositoryEntry/{n}/coursenode/{k}?x=1",
    "/goto.php?target=fold_{k}&cmd=view",
    "https://H.example:443/x?node_id={k}&cmd=show#top",
    "https://other.example/x?cmdNode=a{n}&baseClass=y",
    "/x?cmd=Edit&noise={k}",
    "/auth/RepositoryEntry/9{n}",
    "/x?cmd=view",
    "/sendfile/{k}.PDF",
    "/login?target=file_{k}",
    "/files/sheet{k}.zip",
    "/auth/home?n={n}",
]


def _filled(shapes: list[str], key: Column, nation: Column) -> Column:
    """The shape that a number's remainder names, with both numbers in it."""
    shape = F.get(F.array(*map(F.lit, shapes)), (key % len(shapes)).cast("int"))
    return F.replace(F.replace(shape, F.lit("{k}"), key.cast("string")), F.lit("{n}"), nation.cast("string"))


def customer_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, entry, course, href, title) of customers as links of their nations' pages."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey", "c_name", "c_mktsegment")
    title = F.when(F.col("c_custkey") % 10 == 3, "Forum").when(F.col("c_custkey") % 10 == 4, "  ").when(F.col("c_custkey") % 10 == 5, F.col("c_mktsegment")).otherwise(F.concat(F.lit(" - "), "c_name", F.lit(",")))
    return c.select(F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("string").alias("entry"), F.col("c_mktsegment").alias("course"), _filled(SHAPES, F.col("c_custkey"), F.col("c_nationkey")).alias("href"), title.alias("title"))


def section_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What section of its entry each link stands for, and the entry it names itself."""
    url = U.resolve(F.lit(f"{BASE}/start"), F.col("href"))
    return customer_links(spark, sf_dir).select("k", url.alias("url"), "entry").select("k", "url", U.section_key(F.col("url"), F.col("entry")).alias("key"), U.entry_id(F.col("url")).alias("own"), U.same_host(F.col("url"), F.lit(BASE)).alias("same_host"), U.group_folder(F.concat(F.lit(" "), "url")).alias("folder"))


def link_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which links are files or sections, and which of them may be followed."""
    links = customer_links(spark, sf_dir).withColumn("url", U.resolve(F.lit(f"{BASE}/start"), F.col("href")))
    href, title, url, entry = (F.col(c) for c in ("href", "title", "url", "entry"))
    return links.select(
        "k",
        P.is_file(href, title).alias("is_file"),
        P.is_section_folder(href, title).alias("is_folder"),
        P.is_section(href, title).alias("is_section"),
        P.section_allowed(url, entry).alias("section_allowed"),
        P.file_allowed(url, entry, F.lit(BASE)).alias("file_allowed"),
        P.folder_target(title, url, F.col("course")).alias("folder_target"),
    )


def link_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of links as files and as sections."""
    links = customer_links(spark, sf_dir)
    return links.select("k", T.file_name(F.col("title"), F.lit(""), F.col("href")).alias("file"), T.section_title(F.col("title"), F.col("course")).alias("section"))


def _supplier_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_url, entry, course, section, html): a page for each supplier with two files in a table, and a link that is none."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_nationkey")
    # a file of suppliers is small and one task's, its pages aren't
    s = s.repartition(max(1, -(-s.count() // PAGES)), "s_suppkey")
    k, n = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    row = lambda name, text: F.concat(F.lit('<tr><td><a href="/sendfile/'), name, F.lit('" data-file-name="'), name, F.lit('">'), name, F.lit("</a></td><td>"), text, F.lit("</td></tr>"))
    one, two = F.concat(F.lit("sheet"), k, F.lit(".pdf")), F.concat(F.lit("common"), n, F.lit(".zip"))
    page = F.concat(F.lit("<table>"), row(one, F.concat(k, F.lit(" KB am 1.2.2030"))), row(two, F.lit("2 MB")), F.lit('</table><a href="/login">anmelden</a>'))
    return s.select(F.concat(F.lit(f"{BASE}/auth/RepositoryEntry/"), n, F.lit("/CourseNode/"), k).alias("page_url"), n.alias("entry"), F.concat(F.lit("Course "), n).alias("course"), F.concat(F.lit("Part: "), k).alias("section"), page.alias("html"))


def file_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of all pages with sizes and dates; what several pages of a course link to comes once."""
    return L.files(_supplier_pages(spark, sf_dir), BASE)


PLACES = [("Course 1*/Part: 3", "own/three"), ("*/part: 4*", "/abs/four")]


def file_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each file goes, and its key in the state."""
    found = L.placed(L.files(_supplier_pages(spark, sf_dir), BASE), [("Course 2*", "twos")], [("Part: 5", "fives")], PLACES, "/root")
    return found.select("course", "url", "key", "path")


QUERIES = {f.__name__: f for f in (section_keys, link_kinds, link_names, file_listing, file_places)}


def _any(x: str, needles: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{n}')" for n in needles) + ")"


_SHAPE = "replace(replace((" + str(SHAPES) + f")[(c_custkey % {len(SHAPES)})::INT + 1], '{{k}}', c_custkey::VARCHAR), '{{n}}', c_nationkey::VARCHAR)"
_LINKS = f"""WITH l AS (SELECT c_custkey AS k, c_nationkey::VARCHAR AS entry, c_mktsegment AS course, {_SHAPE} AS href,
        CASE c_custkey % 10 WHEN 3 THEN 'Forum' WHEN 4 THEN '  ' WHEN 5 THEN c_mktsegment ELSE ' - ' || c_name || ',' END AS title FROM customer),
    u AS (SELECT *, CASE WHEN starts_with(href, 'http') THEN href ELSE '{BASE}' || href END AS url, lower(trim(href)) AS h, lower(trim(title)) AS t FROM l),
    p AS (SELECT *, regexp_extract(url, '/RepositoryEntry/(\\d+)', 1, 'i') AS own, regexp_extract(url, '/coursenode/(\\d+)(/[^?#]*)?', 1, 'i') AS node, trim(regexp_extract(url, '/coursenode/(\\d+)(/[^?#]*)?', 2, 'i'), '/') AS tail,
        regexp_extract(url, '[?&]target=([^&#]*)', 1) AS target, regexp_extract(url, '[?&]node_id=([^&#]*)', 1) AS node_id, regexp_extract(url, '[?&]cmdNode=([^&#]*)', 1) AS cmd_node, lower(regexp_extract(url, '[?&]cmd=([^&#]*)', 1)) AS cmd FROM u)"""
_HOST = "lower(regexp_extract(url, '^https?://([^/:]*)', 1)) = 'h.example'"
_ALLOWED = f"(own = '' OR own = entry) AND NOT {_any('lower(url)', P.OVERVIEWS)}"
_FILES = f"""f AS (SELECT s_nationkey, s_suppkey, 'Course ' || s_nationkey AS course, 'Part: ' || s_suppkey AS section, '{BASE}/auth/RepositoryEntry/' || s_nationkey || '/CourseNode/' || s_suppkey AS section_url FROM supplier),
    files AS (SELECT *, 'sheet' || s_suppkey || '.pdf' AS name, s_suppkey * 1024 AS size, '1.2.2030' AS modified FROM f
              UNION ALL SELECT *, 'common' || s_nationkey || '.zip', 2097152, NULL FROM f QUALIFY row_number() OVER (PARTITION BY course ORDER BY section_url) = 1)"""
ORACLES = {
    "section_keys": f"""{_LINKS} SELECT k, url, CASE WHEN node <> '' THEN 'repo|' || entry || '|coursenode|' || node || CASE WHEN tail <> '' THEN '|path|' || lower(url_decode(tail)) ELSE '' END
        WHEN own <> '' AND own <> entry THEN 'foreign-repo|' || own WHEN regexp_matches(target, '^(fold|grp|crs)_') THEN 'repo|' || entry || '|target|' || target WHEN node_id <> '' THEN 'repo|' || entry || '|node|' || node_id
        WHEN cmd_node <> '' THEN 'repo|' || entry || '|cmdnode|' || cmd_node WHEN cmd IN ('', 'view') THEN 'repo|' || entry || '|root' ELSE 'repo|' || entry || '|cmd|' || cmd END AS key, own, {_HOST} AS same_host, rtrim(url, '/') || '/menu/MENU_FOLDER' AS folder FROM p""",
    "link_kinds": f"""{_LINKS} SELECT k, t <> '' AND NOT {_any("h", P.NO_FILE)} AND ({_any("h", P.FILE)} OR regexp_matches(t, '\\.({"|".join(P.FILE_ENDINGS)})$')) AS is_file,
        t <> '' AND NOT {_any("t", P.NO_SECTION_TITLE)} AND NOT {_any("h", P.NO_SECTION)} AND {_any("h", P.SECTION)} AS is_folder,
        t <> '' AND NOT {_any("t", [*P.NO_SECTION_TITLE, P.OVERVIEW_TITLE])} AND NOT {_any("h", P.NO_PLAIN_SECTION)} AND {_any("h", P.SECTION)} AS is_section,
        {_ALLOWED} AS section_allowed, {_ALLOWED} AND {_HOST} AS file_allowed, contains(lower(url), 'target=fold_') OR contains(lower(url), 'target=grp_') OR (node <> '' AND regexp_matches(url, '/coursenode/\\d+/', 'i')) OR t <> lower(course) AS folder_target FROM p""",
    "link_names": f"""{_LINKS}, n AS (SELECT *, trim(title, ' -,') AS name, regexp_extract(href, '([^/]*)/?$', 1) AS last FROM p)
        SELECT k, CASE WHEN name <> '' THEN name ELSE last END AS file, CASE WHEN name <> '' THEN name ELSE course END AS section FROM n""",
    "file_listing": f"WITH {_FILES} SELECT course, section, section_url, name, '{BASE}/sendfile/' || name AS url, size, modified FROM files",
    "file_places": f"""WITH {_FILES}, s AS (SELECT *, CASE WHEN section = 'Part: 5' OR contains(lower(section), 'part: 5') THEN 'fives' ELSE replace(section, ':', '_') END AS folder,
            CASE WHEN starts_with(course, 'Course 2') THEN 'twos' ELSE course END AS place,
            CASE WHEN starts_with(course, 'Course 1') AND contains(section, 'Part: 3') THEN 'own/three' WHEN starts_with(section, 'Part: 4') THEN '/abs/four' END AS override FROM files)
        SELECT course, '{BASE}/sendfile/' || name AS url, CASE WHEN override LIKE '/%' THEN course || '/' || folder ELSE coalesce(override, place || '/' || folder) END || '/' || name AS key,
            CASE WHEN override LIKE '/%' THEN override ELSE '/root/' || coalesce(override, place || '/' || folder) END || '/' || name AS path FROM s""",
}
