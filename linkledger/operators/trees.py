"""Trees that pages embed, and what can be reached over links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import html as H
from ..functions import text as T

COURSE_NODE, GROUP = r"/CourseNode/(\d+)", r"/BusinessGroup/(\d+)(?:[/?#]|$)"


def _walked(pages: DataFrame, key: str, body: str) -> DataFrame:
    """(key, place, depth, href, title, text, class, li_class) of all nodes of a page's trees; place puts parents before children, in their order.

    Trees are variants, opened level by level; each level is cut, and the first empty one ends
    the walk, so trees may have any depth. Nodes that are no objects, and children that are no
    lists (but `true`, for what comes later), hold nothing.
    """
    from ..sources.tables import cut

    nodes = lambda v, path: F.try_variant_get(v, path, "array<variant>")
    text = lambda path: F.coalesce(F.try_variant_get("v", path, "string"), F.lit(""))
    arrays = pages.where(F.col(body).rlike(H.TREES)).select(key, F.posexplode(H.embedded_arrays(F.col(body))).alias("_tree", "v"))
    level = cut(arrays.select(key, F.array("_tree").alias("place"), F.posexplode(nodes(F.col("v"), "$")).alias("_pos", "v")).select(key, F.concat("place", F.array("_pos")).alias("place"), "v"))
    out, depth = None, 0
    while out is None or not level.isEmpty():
        read = level.select(key, "place", F.lit(depth).alias("depth"), T.strip(text("$.a_attr.href")).alias("href"), text("$.a_attr.title").alias("title"), text("$.text").alias("text"), text("$.a_attr.class").alias("class"), text("$.li_attr.class").alias("li_class"))
        out = read if out is None else out.unionByName(read)
        below = level.select(key, "place", F.posexplode(nodes(F.col("v"), "$.children")).alias("_pos", "v"))
        level, depth = cut(below.select(key, F.concat("place", F.array("_pos")).alias("place"), "v")), depth + 1
    return out


def _fitting(pages: DataFrame, key: str, body: str, pattern: str) -> DataFrame:
    """The nodes whose address fits, the first of each page and address, with its id."""
    fits = _walked(pages, key, body).withColumn("id", F.regexp_extract("href", pattern, 1)).where("id <> ''")
    first = fits.groupBy(key, F.col("href").alias("url")).agg(F.min_by(F.struct("id", "title", "text", "class", "li_class", "depth"), "place").alias("n"), F.min("place").alias("place"))
    return first.select(key, "url", "place", "n.*")


def tree_nodes(pages: DataFrame, key: str, body: str, pattern: str = COURSE_NODE) -> DataFrame:
    """A row for each node of a page's embedded trees whose address fits: key, pos, id, url, class, title and depth.

    The first of equal addresses counts, parents before children (pos); depth counts all nodes
    above it. The class is the link's, else the list item's; the title is the attribute, else
    the label without tags, its character references as they are.
    """
    nodes = _fitting(pages, key, body, pattern)
    pos = F.row_number().over(Window.partitionBy(key).orderBy("place")) - 1
    title = F.when(T.strip(F.col("title")) != "", T.strip(F.col("title"))).otherwise(H.plain(F.col("text")))
    kind = F.when(T.strip(F.col("class")) != "", T.strip(F.col("class"))).otherwise(T.strip(F.col("li_class")))
    return nodes.select(key, pos.cast("int").alias("pos"), "id", "url", kind.alias("class"), title.alias("title"), "depth")


def groups(pages: DataFrame, key: str, body: str) -> DataFrame:
    """The groups of a page's embedded trees: key, id, url and title, the label before the attribute, references resolved."""
    nodes = _fitting(pages, key, body, GROUP)
    label, title = (T.collapse(H.unescape(x)) for x in (H.plain(F.col("text")), F.col("title")))
    return nodes.select(key, "id", "url", F.when(label != "", label).otherwise(title).alias("title"))


def reachable(roots: DataFrame, links: DataFrame, most: int = 500) -> DataFrame:
    """(root, node, depth): nodes within reach of each root, nearest first, then by node, `most` of a root at most.

    roots: (root, node); links: (source, target). A round joins the frontier with the links,
    takes away what was seen and numbers the rest of each root; a root that has its `most`
    ends there, so nothing beyond is explored and there are `most` rounds at the most, however
    long a chain is. Each round is checkpointed, and what was seen is written anew at times.
    """
    from ..sources.tables import cut

    frontier = cut(roots.select("root", "node").distinct().withColumn("depth", F.lit(0)).withColumn("_nth", F.row_number().over(Window.partitionBy("root").orderBy("node")))).where(F.col("_nth") <= most)
    frontier = frontier.withColumn("_all", F.max("_nth").over(Window.partitionBy("root")))
    seen, depth = frontier, 0
    while not frontier.isEmpty():
        depth += 1
        open_ = frontier.where(F.col("_all") < most)
        next_ = open_.join(links, F.col("node") == F.col("source")).select("root", F.col("target").alias("node"), "_all").distinct().join(seen.select("root", "node"), ["root", "node"], "left_anti")
        ranked = next_.withColumn("_nth", F.row_number().over(Window.partitionBy("root").orderBy("node")) + F.col("_all")).where(F.col("_nth") <= most)
        frontier = cut(ranked.select("root", "node", F.lit(depth).alias("depth"), "_nth", F.max("_nth").over(Window.partitionBy("root")).alias("_all")))
        seen = seen.unionByName(frontier)
        if depth % 10 == 0:
            seen = cut(seen)
    return seen.select("root", "node", "depth")


#: Fixed value: nodes of a root at most.
MOST_NODES = 500


def folders_by_name(listing: DataFrame) -> DataFrame:
    """listing (path, modified) with match_name and downloads_leaf: a folder named for its role goes by its parent's name.

    Folders that such a leaf stands for, and folders under a skipped one, are left out.
    """
    parts = F.split(F.regexp_replace("path", "^/+|/+$", ""), "/")
    generic = lambda x: F.lower(F.trim(x)).isin(T.GENERIC_FOLDERS)
    skipped = F.exists(parts, lambda x: x.startswith(".") | F.lower(x).isin(T.SKIPPED_FOLDERS))
    named = F.filter(parts, lambda x: ~generic(x))
    kept = listing.where(~skipped & (F.size(named) > 0)).withColumn("match_name", F.element_at(named, -1)).withColumn("downloads_leaf", generic(F.element_at(parts, -1)))
    parents = kept.where("downloads_leaf").select(F.regexp_replace("path", "/[^/]*/*$", "").alias("path")).distinct()
    return kept.join(parents, "path", "left_anti").select("path", "match_name", "downloads_leaf", "modified")


def tree_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of a page for each region: the region, its nations and their suppliers as a tree, and things that are no nodes."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    url = lambda region, id_: F.concat(F.lit("/RepositoryEntry/"), region, F.lit("/CourseNode/"), id_)
    listed = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x["node"])
    nations = read("nation").select("n_nationkey", "n_name", "n_regionkey")
    leaf = F.struct(F.col("s_name").alias("text"), F.struct(url(F.col("n_regionkey"), F.col("s_suppkey") + 10000).alias("href"), F.lit("node-bc ").alias("class")).alias("a_attr"), F.lit(True).alias("children"))
    leaves = read("supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_nationkey").agg(listed(F.struct("s_suppkey", leaf.alias("node"))).alias("children"))
    branch = F.struct(F.concat(F.lit("<b>"), "n_name", F.lit("</b> &amp; more")).alias("text"), F.struct(F.when(F.col("n_nationkey") % 4 == 1, "/Overview").otherwise(url(F.col("n_regionkey"), F.col("n_nationkey"))).alias("href")).alias("a_attr"), F.struct(F.lit("node-st").alias("class")).alias("li_attr"), F.col("children"))
    regions = nations.join(leaves, "n_nationkey", "left").groupBy("n_regionkey").agg(listed(F.struct("n_nationkey", branch.alias("node"))).alias("children")).join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    top = F.array(F.struct(F.lit("ignored ]").alias("text"), F.struct(url(F.col("r_regionkey"), F.col("r_regionkey") + 1000).alias("href"), F.concat(F.col("r_name"), F.lit(' "x"')).alias("title")).alias("a_attr"), F.col("children")))
    pages = regions.select(F.col("r_name").alias("page"), F.concat(F.lit("<script>var  initial_data="), F.to_json(top), F.lit('; var more = [1];</script> var initial_data = [{"text": null, "a_attr": {"href": "/CourseNode/7 "}}, 5, null];')).alias("html"))
    return tree_nodes(pages.unionByName(pages.select(F.concat("page", F.lit(" cut")).alias("page"), F.substring("html", 1, 60).alias("html"))), "page", "html")


def reachable_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts within reach of each brand's first part: from an order's line to its next one."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey")
    after = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("target"))
    links = lines.join(after, ["l_orderkey", "l_linenumber"]).select(F.col("l_partkey").alias("source"), "target").where("source <> target").distinct()
    roots = spark.read.parquet(f"{sf_dir}/part.parquet").groupBy("p_brand").agg(F.min("p_partkey").alias("node")).select(F.col("p_brand").alias("root"), "node")
    return reachable(roots, links, most=MOST_NODES)


QUERIES = {"tree_nodes": tree_listing, "reachable_pages": reachable_pages}
ORACLES = {
    "tree_nodes": """
        WITH n AS (SELECT r_name AS page, r_regionkey AS r, n_nationkey AS n, n_name FROM nation JOIN region ON n_regionkey = r_regionkey),
        nodes AS (SELECT r_name AS page, r_regionkey AS r, -1 AS n, -1 AS s, (r_regionkey + 1000)::VARCHAR AS id, '' AS class, r_name || ' "x"' AS title, 0 AS depth FROM region
                  UNION ALL SELECT r_name, r_regionkey, 1000, 1000, '7', '', '', 0 FROM region
                  UNION ALL SELECT page, r, n, -1, n::VARCHAR, 'node-st', n_name || ' &amp; more', 1 FROM n WHERE n % 4 <> 1
                  UNION ALL SELECT page, r, n, s_suppkey, (s_suppkey + 10000)::VARCHAR, 'node-bc', s_name, 2 FROM n JOIN supplier ON s_nationkey = n)
        SELECT page, (row_number() OVER (PARTITION BY page ORDER BY n, s) - 1)::INT AS pos, id, CASE WHEN n = 1000 THEN '' ELSE '/RepositoryEntry/' || r END || '/CourseNode/' || id AS url, class, title, depth FROM nodes""",
    "reachable_pages": """
        WITH RECURSIVE links AS (SELECT DISTINCT a.l_partkey AS source, b.l_partkey AS target FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber + 1 = b.l_linenumber WHERE a.l_partkey <> b.l_partkey),
        reach AS (SELECT p_brand AS root, min(p_partkey) AS node, 0 AS depth FROM part GROUP BY 1 UNION SELECT root, target, depth + 1 FROM reach JOIN links ON node = source WHERE depth < 12)
        SELECT root, node, min(depth)::INT AS depth FROM reach GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY root ORDER BY min(depth), node) <= 500""",
}
