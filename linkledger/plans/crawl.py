"""A crawl over captured pages: from each course's root to its sections and their files, in the order in which a crawl would reach them.

Pages are (url, html). Sections lead to sections by the tree that a root embeds and by
links, their own and those of the page that lists all entries of a table. Files come from
the same pages and from documents shown in frames, which lead to no sections. A course
stops at `most` sections. That is decided in each round, so nothing beyond it is explored,
and a crawl ends after `most` rounds at the latest. What then still waits is counted.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import html as H
from ..functions import predicates as P
from ..functions import text as T
from ..functions import urls as U
from ..operators import trees
from ..sources.tables import cut

#: Fixed value: sections of a course at most.
MOST_SECTIONS = 500
#: Rounds after which what was seen is written anew as one table.
FOLD = 10
#: Where links of a page come in its order: its tree, its own anchors, those of the page with all entries, those of documents in frames.
TREE, OWN, ALL, FRAMED = 0, 1, 2, 3


class Crawl(NamedTuple):
    """sections: entry, course, key, url, title, depth, nth (from 1, null for skipped ones) and skipped; waiting: entry and key of what the cap left out; links: what led there."""

    sections: DataFrame
    waiting: DataFrame
    links: DataFrame


def page_links(pages: DataFrame, base: str) -> DataFrame:
    """(source, kind, pos, target, url, title, text, class_name, file_name, row_text) of every page: what its anchors, its list of all entries, its frames and its tree lead to."""
    own = H.anchors(pages.select("url", "html"), ["url"])
    own = own.withColumn("target", U.link_target(F.col("href"), F.col("onclick"), F.col("data_href"), F.col("data_url"))).where("target <> ''")
    own = cut(own.select(F.col("url").alias("source"), "pos", "target", "title", "text", "class_name", "file_name", "row_text"))
    columns = ["source", "kind", "pos", "target", "url", "title", "text", "class_name", "file_name", "row_text"]

    def led(first: Column, on: Column) -> DataFrame:
        return own.select(first.alias("source"), "pos", "target", on.alias("url"), "title", "text", "class_name", "file_name", "row_text")

    absolute = U.resolve(F.lit(base), F.col("target"))
    direct = led(F.col("source"), absolute).withColumn("kind", F.lit(OWN))
    lists = pages.select("url", H.show_all_url(F.col("html")).alias("rel")).where("rel <> ''").select(F.col("url").alias("_from"), U.resolve(F.lit(base), F.col("rel")).alias("_to"))
    through = lists.join(own, F.col("_to") == F.col("source")).withColumn("source", F.col("_from")).withColumn("url", absolute).withColumn("kind", F.lit(ALL))
    frames = pages.select(F.col("url").alias("_from"), F.posexplode(H.frame_documents(F.col("html"), F.lit(base))).alias("_at", "_to"))
    framed = frames.join(own, F.col("_to") == F.col("source")).withColumn("url", U.resolve(F.col("_to"), F.col("target")))
    # a file in prose is named by its address, and nothing beside it tells of its size
    framed = framed.withColumn("title", T.first_text(U.document_name(F.col("url")), F.col("title"))).withColumn("row_text", F.lit("")).withColumn("file_name", F.lit("")).withColumn("target", F.col("url"))
    framed = framed.withColumn("source", F.col("_from")).withColumn("pos", F.col("_at") * (1 << 24) + F.col("pos")).withColumn("kind", F.lit(FRAMED))
    return cut(direct.select(columns).unionByName(through.select(columns)).unionByName(framed.select(columns)).unionByName(_tree_links(pages, base).select(columns)))


def _tree_links(pages: DataFrame, base: str) -> DataFrame:
    """The nodes of pages' trees as links."""
    nodes = trees.tree_nodes(pages.select(F.col("url").alias("source"), "html"), "source", "html")
    blank = F.lit("")
    return nodes.select("source", F.lit(TREE).alias("kind"), "pos", F.col("url").alias("target"), U.resolve(F.lit(base), F.col("url")).alias("url"), "title", blank.alias("text"), F.col("class").alias("class_name"), blank.alias("file_name"), blank.alias("row_text"))


def section_links(links: DataFrame) -> DataFrame:
    """(source, kind, pos, url, title, skip) of links that may lead to sections of some course."""
    title = T.section_title(F.col("title"), F.col("text"))
    name = T.file_name(F.col("title"), F.col("text"), F.col("target"))
    # bound, so that what they judge is computed once and not written out for each word they look for
    fits = T.bind(F.struct("target", "section", "name"), lambda x: P.is_section_folder(x["target"], x["section"]) & ~P.is_file(x["target"], x["name"]))
    named = links.where(F.col("kind") < FRAMED).withColumn("section", F.when(F.col("kind") == TREE, F.col("title")).otherwise(title)).withColumn("name", name)
    return named.where((F.col("kind") == TREE) | fits).select("source", "kind", "pos", "url", F.col("section").alias("title"), P.is_empty_node(F.col("class_name")).alias("skip"))


def crawl(courses: DataFrame, pages: DataFrame, base: str, most: int = MOST_SECTIONS) -> Crawl:
    """The sections that each course (entry, title, url) reaches, `most` of a course at most, in the order of a queue.

    The first offer of a section counts, and the title it comes with. Sections that never hold
    files are listed as skipped, lead nowhere and aren't counted. A round's offers of a course
    are the links of `most` pages at most, so no course grows beyond a task.
    """
    links = page_links(pages, base)
    edges = cut(section_links(links))
    root = courses.select("entry", F.col("title").alias("course"), "url", F.col("title"))
    frontier = cut(root.withColumn("key", U.section_key(F.col("url"), F.col("entry"))).dropDuplicates(["entry"]).withColumn("depth", F.lit(0)).withColumn("nth", F.lit(1).cast("long")).withColumn("skipped", F.lit(False)).withColumn("_all", F.lit(1).cast("long")))
    seen, waiting, depth = frontier, None, 0
    while not frontier.isEmpty():
        depth += 1
        offers = frontier.where("not skipped").select("entry", "course", F.col("nth").alias("_by"), "_all", F.col("url").alias("source"))
        offers = offers.join(edges if depth == 1 else edges.where(F.col("kind") > TREE), "source")
        allowed = T.bind(F.struct("url", "title", "entry", "course"), lambda x: P.section_allowed(x["url"], x["entry"]) & P.folder_target(x["title"], x["url"], x["course"]))
        offers = offers.where((F.col("kind") == TREE) | allowed).withColumn("key", T.bind(F.struct("url", "entry"), lambda x: U.section_key(x["url"], x["entry"])))
        order = F.struct("_by", "kind", "pos")
        first = offers.groupBy("entry", "key").agg(F.min_by(F.struct("course", "url", "title", "kind", "skip", "_all"), order).alias("o"), F.min(order).alias("_order"))
        new = first.join(seen.select("entry", "key"), ["entry", "key"], "left_anti").select("entry", "key", "o.*", "_order")
        place = F.row_number().over(Window.partitionBy("entry", "skip").orderBy("_order"))
        ranked = new.withColumn("nth", F.when(~F.col("skip"), F.col("_all") + place))
        level = cut(
            ranked.withColumn("_all", F.max("nth").over(Window.partitionBy("entry"))).select(
                "entry", "course", "url", F.when(F.col("kind") == TREE, F.col("title")).otherwise(T.safe_name(F.col("title"))).alias("title"), "key", F.lit(depth).alias("depth"), "nth", F.col("skip").alias("skipped"), F.coalesce("_all", F.lit(0).cast("long")).alias("_all")
            )
        )
        left = level.where(F.col("nth") > most).select("entry", "key")
        waiting = left if waiting is None else waiting.unionByName(left)
        frontier = level.where(F.col("skipped") | (F.col("nth") <= most))
        seen = seen.unionByName(frontier)
        if depth % FOLD == 0:
            seen, waiting = cut(seen), cut(waiting.distinct())
    empty = seen.select("entry", "key").where("false")
    return Crawl(seen.drop("_all"), (waiting.distinct() if waiting is not None else empty), links)


def warnings(found: Crawl, most: int = MOST_SECTIONS) -> DataFrame:
    """(entry, sections, skipped, waiting, capped) of each course: whether the cap ended its crawl, and how many sections were still queued."""
    counts = found.sections.groupBy("entry").agg(F.count_if(~F.col("skipped")).alias("sections"), F.count_if("skipped").alias("skipped"))
    left = found.waiting.groupBy("entry").agg(F.count("*").alias("waiting"))
    joined = counts.join(left, "entry", "left").withColumn("waiting", F.coalesce("waiting", F.lit(0).cast("long")))
    return joined.withColumn("capped", (F.col("sections") >= most) & (F.col("waiting") > 0))


def crawled_files(found: Crawl, base: str) -> DataFrame:
    """(entry, course, section, section_url, name, url, size, modified): the files of the sections, the first link of each course and address."""
    visited = found.sections.where("not skipped").select("entry", "course", F.col("title").alias("section"), F.col("url").alias("section_url"), "nth")
    links = found.links.where(F.col("kind") > TREE).withColumn("name", T.file_name(F.col("title"), T.first_text(F.col("file_name"), F.col("text")), F.col("target")))
    files = links.where(T.bind(F.struct("target", "name"), lambda f: P.is_file(f["target"], f["name"])))
    joined = visited.join(files.drop("title"), F.col("section_url") == F.col("source"))
    allowed = joined.where(T.bind(F.struct("url", "entry"), lambda x: P.file_allowed(x["url"], x["entry"], F.lit(base))))
    best = allowed.groupBy("entry", "url").agg(F.min_by(F.struct("course", "section", "section_url", "name", "row_text"), F.struct("nth", "kind", "pos")).alias("f"))
    return best.select("entry", "f.course", "f.section", "f.section_url", "f.name", "url", T.size_bytes(F.col("f.row_text")).alias("size"), T.modified_text(F.col("f.row_text")).alias("modified"))


BASE, COURSES, CAP = "https://h.example", 5, 40


def captured(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Courses, and the pages of sections, of lists of all entries and of framed documents, around the bodies of the table's pages.

    The pages of a course are numbered; the j-th leads to 2j + 1 and 2j + 2, and every third one through its list to 2j + 3.
    """
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html").withColumn("e", (F.col("page_id") % COURSES).cast("string")).withColumn("j", F.floor(F.col("page_id") / COURSES))
    text = lambda *parts: F.concat(*(x if isinstance(x, Column) else F.lit(x) for x in parts))
    node = lambda j: text("/auth/RepositoryEntry/", F.col("e"), "/CourseNode/", j.cast("string"))
    classes = lambda j: F.when(j % 11 == 10, "node-en").otherwise("node-st")
    link = lambda j: text('<a href="', node(j), '" class="', classes(j), '" title="Part ', j.cast("string"), '">x</a>')
    j = F.col("j")
    url = text(BASE, F.when(j == 0, text("/auth/RepositoryEntry/", F.col("e"))).otherwise(node(j)))
    tree = text('<script>var initial_data = [{"text": "Tree <b>1</b>", "a_attr": {"href": "', node(F.lit(1)), '"}, "children": true}];</script>')
    more = text('<script>f({"u":"', F.replace(node(j), F.lit("/"), F.lit("\\/")), '?1-pager-showAllLink"})</script>')
    frame = text('<iframe id="f" src="/docs/', F.col("page_id").cast("string"), '.html?v=1&amp;w=2"></iframe><iframe src="https://k.example/x.html"></iframe>')
    table = text('<table><tr><td><a data-file-name="s" href="/sendfile/s', F.col("page_id").cast("string"), '.pdf">s', F.col("page_id").cast("string"), ".pdf</a></td><td>", j.cast("string"), ' KB</td></tr></table><a href="/sendfile/all', F.col("e"), '.zip">all</a>')
    sections = p.select(url.alias("url"), F.concat("html", F.when(j == 0, tree).otherwise(""), F.when(j % 3 == 0, more).otherwise(""), F.when(j % 4 == 1, frame).otherwise(""), table, link(2 * j + 1), link(2 * j + 2), text('<a href="/auth/RepositoryEntry/9">other</a>')).alias("html"))
    lists = p.where(j % 3 == 0).select(text(BASE, node(j), "?1-pager-showAllLink").alias("url"), text(link(2 * j + 3), '<a href="/sendfile/more', F.col("page_id").cast("string"), '.pdf">more.pdf</a>').alias("html"))
    documents = p.where(j % 4 == 1).select(text(BASE, "/docs/", F.col("page_id").cast("string"), ".html?v=1&w=2").alias("url"), text('see <a href="../files/p', F.col("page_id").cast("string"), '%20x.pdf">this</a>', link(j + 100)).alias("html"))
    courses = p.where("j = 0").select(F.col("e").alias("entry"), text("Course ", F.col("e")).alias("title"), url.alias("url"))
    return courses, sections.unionByName(lists).unionByName(documents)


def crawl_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections that the courses' crawls reach, in their order, and how they ended."""
    found = crawl(*captured(spark, sf_dir), BASE, CAP)
    return found.sections.join(F.broadcast(warnings(found, CAP).select("entry", "waiting", "capped")), "entry").select("entry", "key", "url", "title", "depth", "nth", "skipped", "waiting", "capped")


def crawl_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of those sections, the first link of each course and address."""
    return crawled_files(crawl(*captured(spark, sf_dir), BASE, CAP), BASE).drop("course", "modified")


QUERIES = {f.__name__: f for f in (crawl_sections, crawl_files)}
# a queue's order is that of the ways that lead to a section, by length, then link by link
_REACHED = f"""
    WITH RECURSIVE n AS (SELECT page_id, page_id % {COURSES} AS e, page_id // {COURSES} AS j FROM pages),
    links AS (SELECT e, j, 2 * j + k AS c, k FROM (SELECT e, j, unnest(CASE WHEN j % 3 = 0 THEN [1, 2, 3] ELSE [1, 2] END) AS k FROM n)),
    ways AS (SELECT e, j, 0 AS depth, []::BIGINT[] AS way FROM n WHERE j = 0
             UNION ALL SELECT w.e, c, depth + 1, list_append(way, k::BIGINT) FROM ways w JOIN links l ON l.e = w.e AND l.j = w.j WHERE w.j % 11 <> 10),
    firsts AS (SELECT e, j, min(ROW(depth, way)) AS place, min(depth) AS depth FROM ways GROUP BY e, j),
    queue AS (SELECT e, j, depth, j % 11 = 10 AS skipped, CASE WHEN j % 11 <> 10 THEN row_number() OVER (PARTITION BY e, j % 11 = 10 ORDER BY place) END AS nth FROM firsts),
    offered AS (SELECT DISTINCT l.e, l.c AS j FROM links l JOIN queue q ON q.e = l.e AND q.j = l.j WHERE q.nth <= {CAP}),
    left_over AS (SELECT e, count(*) AS waiting FROM queue JOIN offered USING (e, j) WHERE nth > {CAP} GROUP BY e),
    reached AS (SELECT q.e, q.j, depth, skipped, nth, coalesce(waiting, 0) AS waiting, CASE WHEN q.j = 0 THEN '{BASE}/auth/RepositoryEntry/' || q.e ELSE '{BASE}/auth/RepositoryEntry/' || q.e || '/CourseNode/' || q.j END AS url,
                CASE WHEN q.j = 0 THEN 'Course ' || q.e WHEN q.j = 1 THEN 'Tree 1' ELSE 'Part ' || q.j END AS title
                FROM queue q LEFT JOIN left_over w ON w.e = q.e WHERE nth <= {CAP} OR (skipped AND EXISTS (SELECT 1 FROM offered o WHERE o.e = q.e AND o.j = q.j)))"""
ORACLES = {
    "crawl_sections": f"""{_REACHED}
        SELECT e::VARCHAR AS entry, 'repo|' || e || CASE WHEN j = 0 THEN '|root' ELSE '|coursenode|' || j END AS key, url, title, depth::INT AS depth, nth, skipped, waiting,
               waiting > 0 AND count(*) FILTER (NOT skipped) OVER (PARTITION BY e) >= {CAP} AS capped FROM reached""",
    "crawl_files": f"""{_REACHED},
        own AS (SELECT r.e, r.url AS section_url, r.title AS section, r.nth, n.page_id, n.j FROM reached r JOIN n ON n.e = r.e AND n.j = r.j WHERE NOT r.skipped),
        files AS (SELECT e, section, section_url, 's' AS name, '/sendfile/s' || page_id || '.pdf' AS path, j * 1024 AS size FROM own
                  UNION ALL SELECT e, section, section_url, 'all', '/sendfile/all' || e || '.zip', NULL FROM own WHERE nth = 1
                  UNION ALL SELECT e, section, section_url, 'more.pdf', '/sendfile/more' || page_id || '.pdf', NULL FROM own WHERE j % 3 = 0
                  UNION ALL SELECT e, section, section_url, 'p' || page_id || ' x.pdf', '/files/p' || page_id || '%20x.pdf', NULL FROM own WHERE j % 4 = 1)
        SELECT e::VARCHAR AS entry, section, section_url, name, '{BASE}' || path AS url, size FROM files""",
}
