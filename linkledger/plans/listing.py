"""From captured pages to files with a place, as one lazy plan: anchors, links, files, destinations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import html as H
from ..functions import predicates as P
from ..functions import text as T
from ..functions import urls as U
from ..operators import rules as R


def files(pages: DataFrame, base: str) -> DataFrame:
    """The files that pages (page_url, entry, course, section, html) link to, the first link of each course and address."""
    links = H.anchors(pages, [c for c in pages.columns if c != "html"])
    target = U.link_target(F.col("href"), F.col("onclick"), F.col("data_href"), F.col("data_url"))
    named = T.once(T.once(links, target.alias("target")).where("target <> ''"), T.file_name(F.col("title"), T.first_text(F.col("file_name"), F.col("text")), F.col("target")).alias("name"))
    files = named.where(T.bind(F.struct("target", "name"), lambda f: P.is_file(f["target"], f["name"])))
    absolute = T.once(files, U.resolve(F.col("page_url"), F.col("target")).alias("url"))
    allowed = absolute.where(T.bind(F.col("url"), lambda u: P.file_allowed(u, F.col("entry"), F.lit(base))))
    first = F.row_number().over(Window.partitionBy("course", "url").orderBy("page_url", "pos"))
    return allowed.withColumn("_nth", first).where("_nth = 1").select("course", "section", F.col("page_url").alias("section_url"), "name", "url", T.size_bytes(F.col("row_text")).alias("size"), T.modified_text(F.col("row_text")).alias("modified"))


def placed(found: DataFrame, course_rules: list[tuple[str, str]], section_rules: list[tuple[str, str]], destinations: list[tuple[str, str]], root: str, sections: bool = True) -> DataFrame:
    """files with key and path: a destination by rule, else the course's folder, and in it the section's."""
    folder = R.course_folder(F.col("course"), course_rules)
    section = R.section_folder(F.col("section"), section_rules)
    own = F.concat_ws("/", folder, section) if sections else folder
    named = F.concat_ws("/", T.safe_name(F.col("course")), section) if sections else T.safe_name(F.col("course"))
    override = R.destination(F.col("course"), F.col("section"), F.col("name"), destinations)
    name = T.safe_name(F.col("name"))
    place = F.coalesce(override, own)
    outside = place.rlike(r"^(/|[A-Za-z]:[\\/])")
    return found.withColumn("key", F.concat_ws("/", F.when(outside, F.when(override.isNotNull(), F.concat_ws("/", T.safe_name(F.col("course")), section)).otherwise(named)).otherwise(place), name)).withColumn("path", F.concat_ws("/", T.path_under(F.lit(root), place), name))


def links_to_sections(pages: DataFrame) -> DataFrame:
    """(source, target) of pages (page_url, entry, course, html): section links that stay in the course, by section key."""
    links = H.anchors(pages, [c for c in pages.columns if c != "html"])
    target = U.link_target(F.col("href"), F.col("onclick"), F.col("data_href"), F.col("data_url"))
    title = T.section_title(F.col("title"), F.col("text"))
    url = U.resolve(F.col("page_url"), F.col("target"))
    kept = links.withColumn("target", target).where(P.is_section_folder(F.col("target"), title) & P.section_allowed(url, F.col("entry")) & P.folder_target(title, url, F.col("course")) & ~P.is_empty_node(F.col("class_name")))
    return kept.select(U.section_key(F.col("page_url"), F.col("entry")).alias("source"), U.section_key(url, F.col("entry")).alias("target")).where("source <> target").distinct()
