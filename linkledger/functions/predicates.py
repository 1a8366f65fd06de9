"""Which links are files, sections, or nothing of interest, as boolean columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T
from . import urls as U

#: Parts of addresses and titles by which links are told apart, and endings of file names.
NO_FILE = ["/login", "shibboleth", "logout", "cmd=edit", "cmd=delete", "target=fold_", "target=crs_", "target=grp_", "cmd=view", "cmdclass=ilrepositorygui"]
FILE = ["sendfile", "cmd=sendfile", "target=file_", "file_", "cmd=download", "cmdclass=ilobjfilegui", "cmdclass=ilobjfoldergui", "cmd=export", "/download", "getfile"]
FILE_ENDINGS = ["pdf", "zip", "doc", "docx", "ppt", "pptx", "xls", "xlsx", "txt", "csv", "ipynb", "py", "java", "c", "cpp", "jpg", "jpeg", "png"]
NO_SECTION_TITLE = ["forum", "kalender", "neuigkeiten", "ankündigungen", "mitglieder", "teilnehmer", "bewertung", "statistik", "meine kurse", "katalog"]
OVERVIEW_TITLE = "übersicht"
NO_SECTION = ["target=file_", "cmd=download", "cmd=sendfile", "sendfile", "/download", "mycourses", "membership", "/auth/home", "/auth/repository/catalog", "resource/courses", "resource/resources", "baseclass=ildashboardgui", "baseclass=ilmembershipoverviewgui"]
NO_PLAIN_SECTION = ["/login", "shibboleth", "logout", "mycourses", "membership", "/auth/home", "resource/courses", "resource/resources", "cmd=edit", "cmd=delete", "baseclass=ildashboardgui", "baseclass=ilmembershipoverviewgui", "-pager-", "downloadtablecontainer", "/auth/repository/catalog"]
SECTION = ["target=fold_", "target=grp_", "target=crs_", "goto.php?target=fold_", "goto.php?target=grp_", "goto.php?target=crs_", "/coursenode/", "/repositoryentry/"]
OVERVIEWS = ["/auth/home", "/auth/repository/catalog", "mycourses", "membership", "baseclass=ildashboardgui", "baseclass=ilmembershipoverviewgui", "resource/courses", "resource/resources"]
SHOW_ALL_CLASS = "pager-showall"
SHOW_ALL_TEXT = ["alle anzeigen", "alle einträge anzeigen", "alle elemente anzeigen", "komplette liste anzeigen", "show all", "view all", "display all"]
SHOW_ALL_HREF = ["length=-1", "showall=true", "showall=1", "show_all=true", "show_all=1", "pagesize=-1"]
TABLE_DOWNLOAD = "tabelle herunterladen"
EMPTY_NODE_CLASSES = ["node-en"]


def _low(x: Column) -> Column:
    return F.lower(T.strip(F.coalesce(x, F.lit(""))))


def is_file(href: Column, name: Column) -> Column:
    h, n = _low(href), _low(name)
    by_href = T.contains_any(h, FILE) | n.rlike(rf"\.({'|'.join(FILE_ENDINGS)})$")
    return (n != "") & ~n.contains(TABLE_DOWNLOAD) & ~T.contains_any(h, NO_FILE) & by_href


def is_section_folder(href: Column, title: Column) -> Column:
    h, t = _low(href), _low(title)
    return (t != "") & ~T.contains_any(t, NO_SECTION_TITLE) & ~T.contains_any(h, NO_SECTION) & T.contains_any(h, SECTION)


def is_section(href: Column, title: Column) -> Column:
    h, t = _low(href), _low(title)
    return (t != "") & ~T.contains_any(t, [*NO_SECTION_TITLE, OVERVIEW_TITLE]) & ~T.contains_any(h, NO_PLAIN_SECTION) & T.contains_any(h, SECTION)


def section_allowed(url: Column, entry: Column) -> Column:
    """Whether an address may be a section of the repository entry."""
    own = U.entry_id(url)
    return (T.strip(url) != "") & (T.strip(entry) != "") & ((own == "") | (own == entry)) & ~T.contains_any(F.lower(url), OVERVIEWS)


def file_allowed(url: Column, entry: Column, base: Column) -> Column:
    return section_allowed(url, entry) & U.same_host(url, base)


def has_nested_path(url: Column) -> Column:
    return T.contains_any(F.lower(url), ["target=fold_", "target=grp_"]) | (F.regexp_extract(url, U.NODE, 2) != "")


def folder_target(title: Column, url: Column, course: Column) -> Column:
    """Whether to go on from a course page: to content below it, or to what isn't the course itself."""
    return has_nested_path(url) | (F.lower(T.strip(title)) != F.lower(T.strip(course)))


def is_empty_node(classes: Column) -> Column:
    """Whether a node's classes say that it never holds files."""
    return F.arrays_overlap(F.split(F.coalesce(classes, F.lit("")), r"\s+"), F.array(*map(F.lit, EMPTY_NODE_CLASSES)))


def is_preview(kind: Column, main_frame: Column, url: Column) -> Column:
    return (kind == "document") & ~main_frame & url.contains("/FolderResource/")


def is_show_all(target: Column, text: Column, title: Column, classes: Column) -> Column:
    """Whether a control lists all entries of a table."""
    return _low(classes).contains(SHOW_ALL_CLASS) | T.contains_any(_low(T.first_text(text, title)), SHOW_ALL_TEXT) | T.contains_any(_low(target), SHOW_ALL_HREF)


def leads_somewhere(url: Column) -> Column:
    return ~_low(url).rlike("^(#|javascript:|$)")


def is_generic_folder(name: Column) -> Column:
    return _low(name).isin(T.GENERIC_FOLDERS)


def is_skipped_folder(name: Column) -> Column:
    return name.startswith(".") | _low(name).isin(T.SKIPPED_FOLDERS)


def is_development_version(version: Column) -> Column:
    return version.isin("", "dev")


def course_wanted(title: Column, wanted: list[str]) -> Column:
    """Whether a course is asked for by its whole title; an empty list or * asks for all."""
    if not wanted or "*" in [w.strip() for w in wanted]:
        return F.lit(True)
    return F.lower(T.strip(title)).isin([w.strip().lower() for w in wanted])


def shown_on_console(level: Column, audience: Column, verbose: bool) -> Column:
    """Whether a log line is for the user: everything if verbose, else errors and what is marked so."""
    return F.lit(verbose) | (level >= 8) | (audience == "user")


def error_kind(message: Column) -> Column:
    """What kind of failure a message tells of; the first that fits."""
    m = F.lower(F.coalesce(message, F.lit("")))
    return (
        F.when(m.contains("timeout"), "timeout")
        .when(m.contains("execution context was destroyed"), "context-destroyed")
        .when(m.contains("navigat"), "navigation")
        .when(m.contains("crash"), "crash")
        .when(m.contains("closed"), "closed")
        .otherwise("other")
    )
