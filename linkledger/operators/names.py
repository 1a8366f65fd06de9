"""Queries that apply the text and URL functions to whole columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as T
from ..functions import urls as U


def sanitize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Safe file names of the documents' texts."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", T.safe_name(F.col("text")).alias("name"))


SIZES = ["77 KB", "about 3,25 MB", "0.5GB", "41 Bytes free", "none", "9 kb and 10 MB", "6.543,2 KB"]
DATES = ["seit 2.5.2031 um 8:45 Uhr", "30.11.2029, 23:59 Uhr", "5.6.2030", "no date", "up to 17.12.2028 um 6:30 or later"]


#: What stands before a number in a file name: markers, single letters, and others.
FRONTS = ["Blatt", "ue_", "Serie-", "Übung ", "p", "A", "p_", "nm", "Kapitel", "xBlatt"]


def size_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of a few texts, and of all documents."""
    few = spark.createDataFrame([(-k - 1, t) for k, t in enumerate(SIZES)], "doc_id long, text string")
    return few.unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", T.size_bytes(F.col("text")).alias("size"))


def modified_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of a few texts, and of all documents."""
    few = spark.createDataFrame([(-k - 1, t) for k, t in enumerate(DATES)], "doc_id long, text string")
    return few.unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", T.modified_text(F.col("text")).alias("modified"))


def sheet_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheet numbers of file names made of parts' names and numbers: with markers, single letters, none, and too many digits."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name")
    key, n = F.col("p_partkey"), (F.col("p_partkey") % 130).cast("string")
    marker = F.get(F.array(*map(F.lit, FRONTS)), (key % len(FRONTS)).cast("int"))
    name = F.concat(F.when(key % 3 == 0, F.concat(F.substring_index("p_name", " ", 1), F.lit("_"))).otherwise(""), marker, n, F.when(key % 5 == 0, "-x7").otherwise(""), F.lit(".pdf"))
    return parts.select("p_partkey", name.alias("name")).select("p_partkey", "name", T.sheet_number(F.col("name")).alias("number"))


def version_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether versions made of lines' numbers are newer than others, of two and of three numbers, with a v or not, and some that are none."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    a, b, c, d = (F.col(x).cast("string") for x in ("l_linenumber", "l_part", "l_supp", "l_rest"))
    small = lines.withColumn("l_part", F.col("l_partkey") % 12).withColumn("l_supp", F.col("l_suppkey") % 12).withColumn("l_rest", F.col("l_orderkey") % 3)
    latest = F.concat(F.when(F.col("l_part") == 3, "v").otherwise(""), a, F.lit("."), b, F.lit("."), d)
    current = F.when(F.col("l_part") == 7, "dev").otherwise(F.concat(a, F.lit("."), c))
    return small.select("l_orderkey", "l_linenumber", F.coalesce(T.is_newer(latest, current).cast("string"), F.lit("unknown")).alias("newer"))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's anchors with absolute addresses, the first of each address."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    links = H.anchors(pages, ["page_id", "url"])
    target = U.link_target(F.col("href"), F.col("onclick"), F.col("data_href"), F.col("data_url"))
    found = links.select("page_id", "pos", U.resolve(F.col("url"), target).alias("target"), F.col("text").alias("name")).where("target <> ''")
    return found.groupBy("page_id", "target").agg(F.min("pos").alias("pos"), F.min_by("name", "pos").alias("name"))


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' hosts, paths and addresses for a crawl."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    odd = F.concat(F.regexp_replace("url", "[?#].*$", ""), F.lit("?cmd=view&x=1&target=fold_"), "page_id", F.lit("#top"))
    return pages.select("page_id", U.host(F.col("url")).alias("host"), U.part(F.col("url"), 3).alias("path"), U.crawl_form(odd).alias("crawl"), U.without_query(odd).alias("shown"), U.host_port(F.col("url")).alias("host_port"))


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' titles, as section titles and folder names."""
    title = H.plain(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", title.alias("title"), F.size(F.split(H.plain(F.col("html")), " ")).alias("n_words"))


_CASE = "CASE WHEN upper(name) IN ('CON', 'PRN', 'AUX', 'NUL') OR regexp_matches(upper(name), '^(COM|LPT)[1-9]$') THEN '_' || name ELSE name END"
_FEW = lambda values: "SELECT unnest(range(1, {n} + 1)) * -1 AS doc_id, unnest([{v}]) AS text".format(n=len(values), v=", ".join(f"'{v}'" for v in values))
_UNIT = "CASE upper(regexp_extract(text, '(\\d+(?:[.,]\\d+)?)\\s*(GB|MB|KB|Bytes?)', 2, 'i')) WHEN 'GB' THEN 1073741824 WHEN 'MB' THEN 1048576 WHEN 'KB' THEN 1024 WHEN '' THEN NULL ELSE 1 END"
QUERIES = {f.__name__: f for f in (sanitize_names, size_parse, modified_parse, sheet_number, version_compare, page_links, url_parts, page_text)}
ORACLES = {
    "sanitize_names": rf"""
        WITH a AS (SELECT doc_id, regexp_replace(text, '^[\s\pZ]+|[\s\pZ]+$', '', 'g') AS t FROM documents),
        b AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '[<>:"/\\|?*\x00-\x1F]', '_', 'g'), '\s+', ' ', 'g'), '[. ]+$', '') AS t FROM a),
        c AS (SELECT doc_id, CASE WHEN t = '' THEN 'unnamed' ELSE t END AS name FROM b)
        SELECT doc_id, {_CASE} AS name FROM c""",
    "size_parse": rf"""
        WITH d AS ({_FEW(SIZES)} UNION ALL SELECT doc_id, text FROM documents)
        SELECT doc_id, trunc(try_cast(replace(regexp_extract(text, '(\d+(?:[.,]\d+)?)\s*(GB|MB|KB|Bytes?)', 1, 'i'), ',', '.') AS DOUBLE) * ({_UNIT})::DOUBLE)::BIGINT AS size FROM d""",
    "modified_parse": rf"""
        WITH d AS ({_FEW(DATES)} UNION ALL SELECT doc_id, text FROM documents)
        SELECT doc_id, nullif(regexp_extract(text, '\d{{1,2}}\.\d{{1,2}}\.\d{{4}}(?:,?\s*(?:um\s*)?\d{{1,2}}:\d{{2}}(?:\s*Uhr)?)?', 0), '') AS modified FROM d""",
    # by what was put together: a known marker is the first, and its number has one or two digits; single letters bear no separator
    "sheet_number": f"""
        WITH p AS (SELECT p_partkey, ({FRONTS})[(p_partkey % {len(FRONTS)})::INT + 1] AS front, p_partkey % 130 AS n, CASE WHEN p_partkey % 3 = 0 THEN split_part(p_name, ' ', 1) || '_' ELSE '' END AS head,
                          CASE WHEN p_partkey % 5 = 0 THEN '-x7' ELSE '' END AS tail FROM part)
        SELECT p_partkey, head || front || n || tail || '.pdf' AS name, CASE WHEN n < 100 AND front IN ('Blatt', 'ue_', 'Serie-', 'Übung ', 'p', 'A') THEN n::INT END AS number FROM p""",
    "version_compare": """
        WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey % 12 AS p, l_suppkey % 12 AS s, l_orderkey % 3 AS r FROM lineitem)
        SELECT l_orderkey, l_linenumber, CASE WHEN p = 7 THEN 'unknown' WHEN p > s OR (p = s AND r > 0) THEN 'true' ELSE 'false' END AS newer FROM v""",
    "page_links": r"""
        WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a\s([^>]*)>(.*?)</a>', 0, 'is')) AS anchor, generate_subscripts(regexp_extract_all(html, '<a\s([^>]*)>(.*?)</a>', 0, 'is'), 1) - 1 AS pos FROM pages),
        b AS (SELECT page_id, pos, trim(regexp_extract(regexp_extract(anchor, '<a\s([^>]*)>', 1, 'is'), '(?:^|\s)href="([^"]*)"', 1, 'i')) AS href, regexp_extract(url, '^[a-z]+://[^/]*') AS site,
                     trim(regexp_replace(regexp_replace(regexp_extract(anchor, '<a\s[^>]*>(.*?)</a>', 1, 'is'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS name FROM a)
        SELECT page_id, site || href AS target, min(pos)::INT AS pos, arg_min(name, pos) AS name FROM b WHERE href NOT IN ('', '#') GROUP BY 1, 2""",
    "url_parts": r"""SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1)) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_replace(url, '[?#].*$', '') || '?cmd=view&target=fold_' || page_id AS crawl, regexp_replace(url, '[?#].*$', '') || '?...' AS shown,
        lower(regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1)) || CASE WHEN starts_with(url, 'http:') THEN ':80' ELSE ':443' END AS host_port FROM pages""",
    "page_text": r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '<title>(.*?)</title>', 1, 'is'), '<[^>]*>', ' ', 'gs'), '[\s\pZ]+', ' ', 'g')) AS title,
        len(string_split(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'gs'), '[\s\pZ]+', ' ', 'g')), ' '))::INT AS n_words FROM pages""",
}
