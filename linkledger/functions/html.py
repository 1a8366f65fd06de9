"""What pages hold: anchors, attributes, texts, table rows, frames and embedded JSON."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from . import text as T
from . import urls as U

ANCHOR = r"(?is)<a\s([^>]*)>(.*?)</a>"
ROW = r"(?is)<tr\b[^>]*>.*?</tr>"
FRAME = r"(?is)<iframe\b[^>]*>"
FILE_ANCHOR = r'(?i)data-file-name\s*=\s*"'
#: A character that no page may have, put before each anchor to count them by.
MARK = "\x01"
#: Documents of frames that a page may bring along.
FRAMES = 4
#: What an anchor's tag says, by the columns that it becomes.
ATTRIBUTES = {"href": "href", "onclick": "onclick", "data_href": "data-href", "data_url": "data-url", "title": "title", "class_name": "class", "file_name": "data-file-name"}


@F.pandas_udf(StringType())
def _unescaped(x: pd.Series) -> pd.Series:
    return x.map(lambda t: None if t is None else html.unescape(t))


@F.pandas_udf(ArrayType(StringType()))
def _all_unescaped(x: pd.Series) -> pd.Series:
    return x.map(lambda texts: [None if t is None else html.unescape(t) for t in texts])


def unescape(x: Column) -> Column:
    """A text with its character references resolved; only texts with an ampersand visit Python."""
    return F.when(x.contains("&"), _unescaped(x)).otherwise(x)


def unescape_all(x: Column) -> Column:
    """An array of texts with their character references resolved, in one visit to Python, if any of them has an ampersand."""
    return F.when(F.exists(x, lambda t: t.contains("&")), _all_unescaped(x)).otherwise(x)


def attribute(tag: Column, name: str) -> Column:
    """The last value of an attribute in a tag, character references left as they are; an empty text without one."""
    found = F.regexp_extract_all(tag, F.lit(rf'(?i)(?:^|[\s"]){name}\s*=\s*"([^"]*)"'), F.lit(1))
    return F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit(""))


def plain(x: Column) -> Column:
    """The text of a piece of HTML: tags out, white space collapsed; references stay."""
    return T.collapse(F.regexp_replace(x, r"(?s)<[^>]*>", " "))


def rows_of_anchors(body: Column) -> Column:
    """For each anchor of a page, in order, the row around its start if that has exactly one anchor with data-file-name, else null.

    Anchors are marked, and the page is cut at its rows: the marks in each row, and between
    rows, say how many anchors in turn belong there. So it is one pass over the page and one
    over its rows, however many there are of either.
    """
    marked = F.regexp_replace(body, ANCHOR, f"{MARK}$0")
    count = lambda x: F.length(x) - F.length(F.translate(x, MARK, ""))
    single = lambda row: F.when(F.regexp_count(row, F.lit(FILE_ANCHOR)) == 1, F.translate(row, MARK, ""))
    # as many pieces between rows as rows, and one more
    pieces = lambda page: F.zip_with(F.split(page, ROW, -1), F.regexp_extract_all(page, F.lit(ROW), F.lit(0)), lambda gap, row: F.concat(F.array_repeat(F.lit(None).cast("string"), count(gap)), F.array_repeat(single(row), F.coalesce(count(row), F.lit(0)))))
    return F.flatten(T.bind(marked, pieces))


def anchors(pages: DataFrame, kept: list[str], body: str = "html") -> DataFrame:
    """A row for each anchor: the kept columns, pos (from 0), href, onclick, data_href, data_url, title, class_name, file_name, text and row_text.

    row_text is the text of the table row around an anchor's start if that row has exactly one
    anchor with data-file-name; without such a row it is the anchor's own text. Pages without
    a row with data-file-name aren't searched for rows. Time and memory follow a page's length.
    """
    page = F.translate(F.col(body), MARK, "")
    found = F.regexp_extract_all(page, F.lit(ANCHOR), F.lit(0))
    rows = F.when(page.rlike(FILE_ANCHOR), rows_of_anchors(page)).otherwise(F.array().cast("array<string>"))
    each = pages.select(*kept, F.posexplode(F.arrays_zip(found.alias("anchor"), rows.alias("row"))).alias("pos", "a"))
    head, inner = F.regexp_extract("a.anchor", ANCHOR, 1), F.regexp_extract("a.anchor", ANCHOR, 2)
    bare = lambda x: F.regexp_replace(x, r"(?s)<[^>]*>", " ")
    raw = each.select(*kept, "pos", F.array(*(attribute(head, a) for a in ATTRIBUTES.values()), bare(inner), bare(F.col("a.row"))).alias("raw"))
    values = raw.select(*kept, "pos", unescape_all(F.col("raw")).alias("v"))
    n = len(ATTRIBUTES)
    texts = T.once(values, *(F.get("v", F.lit(k)).alias(c) for k, c in enumerate(ATTRIBUTES)), T.collapse(F.get("v", F.lit(n))).alias("text"), T.collapse(F.get("v", F.lit(n + 1))).alias("row_text")).drop("v")
    return texts.withColumn("row_text", F.coalesce(T.none_if_blank(F.col("row_text")), F.col("text")))


def show_all_url(body: Column) -> Column:
    """The address of a page's list of all entries, from its scripts, or an empty text."""
    return F.replace(F.regexp_extract(body, r'"u"\s*:\s*"([^"]*pager-showAllLink[^"]*)"', 1), F.lit("\\/"), F.lit("/"))


def frame_documents(body: Column, base: Column) -> Column:
    """array of the HTML documents that a page's frames show: absolute, on the same host, distinct, FRAMES at most."""
    sources = F.transform(F.regexp_extract_all(body, F.lit(FRAME), F.lit(0)), lambda t: U.resolve(base, F.replace(F.regexp_extract(t, r'(?i)\bsrc="([^"]*)"', 1), F.lit("&amp;"), F.lit("&"))))
    fit = F.filter(sources, lambda u: U.same_host(u, base) & F.lower(U.part(u, 3)).rlike(r"\.html?$"))
    return F.slice(F.array_distinct(fit), 1, FRAMES)


def anchor_for_file(body: Column, name: Column) -> Column:
    """The first anchor tag whose data-file-name is a given name, or null."""
    escaped = F.replace(F.replace(F.replace(F.replace(name, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    tags = F.regexp_extract_all(body, F.lit(r"(?is)<a\s[^>]*>"), F.lit(0))
    return F.get(F.filter(tags, lambda t: t.contains(F.concat(F.lit('data-file-name="'), escaped, F.lit('"')))), F.lit(0))


def click_url(body: Column, element: Column) -> Column:
    """The address that a click on an element calls: of its behaviours, the one that says so within 800 characters; null without one."""
    after = F.regexp_extract_all(body, F.lit(r'(?s)"u"\s*:\s*"[^"]*"\s*,\s*"c"\s*:\s*"[^"]*"(?:(?!"u"\s*:).){0,800}'), F.lit(0))
    own = F.filter(after, lambda s: (F.regexp_extract(s, r'"c"\s*:\s*"([^"]*)"', 1) == element) & s.rlike(r'"e"\s*:\s*"click"'))
    return F.replace(F.regexp_extract(F.get(own, F.lit(0)), r'"u"\s*:\s*"([^"]*)"', 1), F.lit("\\/"), F.lit("/"))


def redirect_target(body: Column) -> Column:
    """Where an answer's script sends the browser, or an empty text."""
    return F.replace(F.regexp_extract(body, r"""window\.location(?:\.href)?\s*=\s*['"]([^'"]+)['"]""", 1), F.lit("\\/"), F.lit("/"))


def content_region(body: Column) -> Column:
    """A page from its main content to its footer; the whole page where it has neither."""
    start = F.greatest(F.instr(body, 'id="main-content"'), F.lit(0))
    start = F.when(start > 0, start).otherwise(F.instr(body, 'id="content"'))
    rest = F.when(start > 0, F.substring(body, start, F.length(body))).otherwise(body)
    end = F.instr(rest, "<footer")
    return F.when(end > 0, F.substring(rest, F.lit(1), end - 1)).otherwise(rest)


#: What differs between two loads of the same page.
VOLATILE = [
    r"""(?i)jsessionid=[^"'&;\s]*""",
    r"""(?i)\b\d{10,13}\b""",
    r"""(?i)(name|id|for)="[^"]*-[0-9a-f]{6,}\"""",
    r"""(?i)csrf[^"']*["'][^"']+["']""",
    r"""\?\d+-[\d.]+-""",
    r"""\?\d+\"""",
    r"""\b\w+Table_\d+""",
    r"""\bid[0-9a-f]{4,}\b""",
]


def without_volatile(body: Column) -> Column:
    for pattern in VOLATILE:
        body = F.regexp_replace(body, pattern, "X")
    return body


#: Fixed value: what stands before the trees of a page's script.
TREES = r"var\s+initial_data\s*=\s*"


def embedded_arrays(body: Column) -> Column:
    """array<variant> of the JSON arrays that follow each `var initial_data =` of a page's scripts, in order; those that don't end are left out.

    The parser reads one value and stops, whatever script follows, so nothing has to be balanced first.
    """
    parts = F.split(body, TREES, -1)
    begun = F.filter(F.slice(parts, F.lit(2), F.size(parts)), lambda p: p.startswith("["))
    return F.filter(F.transform(begun, F.try_parse_json), lambda v: v.isNotNull())
