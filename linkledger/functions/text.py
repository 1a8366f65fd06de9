"""Text functions as columns: names, sizes, dates, numbers and words. Null stays null unless said otherwise."""

from __future__ import annotations

import functools
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

BLANK = r"[\s\p{Z}]"
#: Names that no file may have on some systems.
RESERVED = ["CON", "PRN", "AUX", "NUL", "COM1", "COM2", "COM3", "COM4", "COM5", "COM6", "COM7", "COM8", "COM9", "LPT1", "LPT2", "LPT3", "LPT4", "LPT5", "LPT6", "LPT7", "LPT8", "LPT9"]
#: Letters and the letters that stand for them in comparisons.
FOLDED = ("äöüáàâãåéèêëíìîïóòôõøúùûñçý", "aouaaaaaeeeeiiiiooooouuuncy")
#: Words of course titles without meaning of their own.
STOP_WORDS = ["und", "and", "oder", "or", "der", "die", "das", "den", "dem", "des", "the", "of", "for", "fur", "mit", "with", "im", "in", "zu", "zur", "zum", "von", "a", "an", "am"]
NOISE_WORDS = ["sose", "wise", "ss", "ws", "so", "wi", "sommer", "winter", "semester", "sem", "modul", "module", "kurs", "kurse", "course"]
#: What stands before the number of a sheet; single letters only without separator.
SHEET_MARKERS = ["blatt", "bl", "uebung", "ubung", "ue", "ub", "loesung", "losung", "loe", "lsg", "serie", "sheet"]
SHEET_LETTERS = ["u", "p", "a", "h"]
SHEET_PLACEHOLDER = "{blatt}"
#: Folders named for their role, and folders that hold no coursework.
GENERIC_FOLDERS = ["downloads", "download", "dl", "files", "dateien", "material", "materialien", "materials", "unterlagen", "dokumente", "documents"]
SKIPPED_FOLDERS = ["node_modules", "$recycle.bin", "appdata", "system volume information"]
#: Sections of a table that lead elsewhere, by words in a title.
NO_SECTION_TITLES = ["gehe zu", "aktuelle seite", "vorherige seite", "nächste seite", "als favorit markieren", "verantwortliche", "zuletzt angesehen", "aufrufe"]

SIZE = r"(?i)(\d+(?:[.,]\d+)?)\s*(GB|MB|KB|Bytes?)"
MODIFIED = r"\d{1,2}\.\d{1,2}\.\d{4}(?:,?\s*(?:um\s*)?\d{1,2}:\d{2}(?:\s*Uhr)?)?"


def bind(x: Column, function) -> Column:
    """function of x, with x computed once however often the function uses it."""
    return F.get(F.transform(F.array(x), function), F.lit(0))


def once(df: DataFrame, *columns: Column) -> DataFrame:
    """df and the columns behind its own, each computed once a row: as generated rows, so that filters on them stay above instead of computing them wherever they name them."""
    return df.select("*", F.inline(F.array(F.struct(*columns))))


def strip(x: Column) -> Column:
    """Without white space at both ends, Unicode spaces included."""
    return F.regexp_replace(x, rf"^{BLANK}+|{BLANK}+$", "")


def collapse(x: Column) -> Column:
    """Stripped, and every run of white space one space."""
    return F.regexp_replace(strip(x), rf"{BLANK}+", " ")


def none_if_blank(x: Column) -> Column:
    return F.when(strip(x) != "", x)


def first_text(*values: Column) -> Column:
    """The first value that isn't blank, as it is, or an empty text."""
    return F.coalesce(*map(none_if_blank, values), F.lit(""))


def contains_any(x: Column, needles: list[str]) -> Column:
    out = F.lit(False)
    for needle in needles:
        out = out | F.contains(x, F.lit(needle))
    return out


def safe_name(x: Column) -> Column:
    """A name that every file system takes; a blank one is `unnamed`."""
    clean = F.regexp_replace(strip(x), r'[<>:"/\\|?*\x00-\x1F]', "_")
    clean = F.regexp_replace(F.regexp_replace(clean, r"\s+", " "), r"[. ]+$", "")
    clean = F.when(clean == "", "unnamed").otherwise(clean)
    return F.when(F.upper(clean).isin(RESERVED), F.concat(F.lit("_"), clean)).otherwise(clean)


@F.pandas_udf(StringType())
def _without_marks(x: pd.Series) -> pd.Series:
    plain = lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn")
    return x.map(plain)


@functools.cache
def _plain_letters() -> tuple[str, str, str]:
    """Letters with marks, and marks; the letters' plain ones; and a class of characters that `translate` can't settle: they become several, or change places."""
    letters, plain, marks, other = [], [], [], []
    for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x30000), *range(0xE0000, 0xE0200)]):
        left = [d for d in unicodedata.normalize("NFD", c) if unicodedata.category(d) != "Mn"]
        if not left:
            marks.append(c)
        elif len(left) > 1 or unicodedata.combining(left[0]):
            other.append(c)
        elif left[0] != c:
            letters.append(c)
            plain.append(left[0])
    rest = "".join(c for c in other if not "\uac00" <= c <= "\ud7a3")
    return "".join(letters + marks), "".join(plain), f"[\uac00-\ud7a3{rest}]"


def match_text(x: Column) -> Column:
    """Lower case without combining marks, white space collapsed: what patterns are matched with.

    Letters are translated. Only texts with the few characters that become several without
    their marks, or whose marks have an order, visit Python (Hangul, some Indic vowels, notes):
    others are null there, since a function in Python is computed for every row.
    """
    lower = F.lower(strip(x))
    letters, plain, other = _plain_letters()
    # a class of many characters is slow, one range is not: none of them comes before it
    special = lower.rlike(r"[\x{9CB}-\x{10FFFF}]") & lower.rlike(other)
    return collapse(F.when(special, _without_marks(F.when(special, lower))).when(lower.rlike(r"[^\x00-\x7F]"), F.translate(lower, letters, plain)).otherwise(lower))


def fold(x: Column) -> Column:
    """Lower case with accented letters, sharp s and slashed o spelled plainly."""
    return F.replace(F.translate(F.lower(x), *FOLDED), F.lit("ß"), F.lit("ss"))


def words(x: Column) -> Column:
    """Folded words, split at other characters, between letters and digits, and where capitals begin one."""
    seams = r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})|(?<=\p{Nd})(?=\p{L})|(?<=\p{L})(?=\p{Nd})"
    spaced = F.regexp_replace(F.regexp_replace(x, seams, " "), r"[^\p{L}\p{Nd}]+", " ")
    return F.filter(F.split(fold(spaced), " "), lambda w: w != "")


def is_numeric(x: Column) -> Column:
    return x.rlike(r"^\p{Nd}+$")


def course_tokens(x: Column) -> Column:
    """The words of a course title that tell it from others."""
    return F.filter(words(F.regexp_replace(x, r"(?i)\b(?:so|wi)se", " ")), lambda w: ~is_numeric(w) & ~w.isin(STOP_WORDS + NOISE_WORDS))


def file_name(title: Column, text: Column, target: Column) -> Column:
    """A link's name: its title or text, tidied, or else the last part of its target."""
    tidy = lambda x: none_if_blank(F.regexp_replace(collapse(x), r"^[ ,-]+|[ ,-]+$", ""))
    path = F.regexp_replace(strip(target), "/+$", "")
    last = F.when(strip(target) == "", ".").when(path == "", "/").otherwise(F.substring_index(path, "/", -1))
    return F.coalesce(tidy(title), tidy(text), last)


def is_section_title(x: Column) -> Column:
    low = F.lower(strip(x))
    return (F.octet_length(low) >= 2) & ~low.rlike("^https?://") & ~contains_any(low, NO_SECTION_TITLES)


def section_title(*values: Column) -> Column:
    """The first value that can be a section's title, tidied, or an empty text."""
    tidied = [F.regexp_replace(collapse(v), r"^[ ,-]+|[ ,-]+$", "") for v in values]
    return F.coalesce(*(F.when(is_section_title(t), t) for t in tidied), F.lit(""))


def size_bytes(x: Column) -> Column:
    """The first size in a text, in bytes of 1024 a step, cut to whole ones; null without one."""
    unit = F.upper(F.regexp_extract(x, SIZE, 2))
    times = F.when(unit == "GB", float(1 << 30)).when(unit == "MB", float(1 << 20)).when(unit == "KB", 1024.0).when(unit != "", 1.0)
    return (F.replace(F.regexp_extract(x, SIZE, 1), F.lit(","), F.lit(".")).try_cast("double") * times).cast("long")


def modified_text(x: Column) -> Column:
    """The first date in a text as it stands there; null without one."""
    return F.nullif(F.regexp_extract(x, MODIFIED, 0), F.lit(""))


def sheet_number(name: Column) -> Column:
    """The number of one or two digits behind a sheet marker in a file name, or null.

    Markers begin where no letter stands before; single letters count where no other does.
    """
    plain = match_text(F.regexp_replace(strip(name), r"\.[^./]*$", ""))
    marked = F.regexp_extract(plain, rf"(?<!\p{{L}})(?:{'|'.join(SHEET_MARKERS)})[ _.-]*([0-9]{{1,2}})(?![0-9])", 1)
    single = F.regexp_extract(plain, rf"(?<!\p{{L}})[{''.join(SHEET_LETTERS)}]([0-9]{{1,2}})(?![0-9])", 1)
    return F.coalesce(F.nullif(marked, F.lit("")), F.nullif(single, F.lit(""))).cast("int")


def sheet_folder(number: Column) -> Column:
    return F.format_string("Blatt%02d", number)


def fill_sheet(destination: Column, number: Column) -> Column:
    """destination with the sheet's folder for the placeholder, in any case."""
    return F.regexp_replace(destination, F.lit(r"(?i)\{blatt\}"), sheet_folder(number))


def int_or_zero(x: Column) -> Column:
    return F.coalesce(F.when(strip(x).rlike(r"^[+-]?\d+$"), strip(x).try_cast("int")), F.lit(0))


def split_detail(x: Column, marker: str) -> Column:
    """struct<short, detail>: a message around a marker; without it, all is short."""
    at = F.instr(x, marker)
    return F.struct(F.when(at > 0, strip(F.substring(x, F.lit(1), at - 1))).otherwise(x).alias("short"), F.when(at > 0, strip(F.substring(x, at + len(marker), F.length(x)))).otherwise("").alias("detail"))


def shorten(x: Column, most: int) -> Column:
    """Texts of more than `most` characters end in an ellipsis, within that length."""
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most - 1), F.lit("…"))).otherwise(x)


def version_numbers(x: Column) -> Column:
    """The numbers of a dotted version with or without leading v; null where a part is no number."""
    bare = F.regexp_replace(strip(x), "^[vV]", "")
    return F.when(bare.rlike(r"^\d+(\.\d+)*$"), F.transform(F.split(bare, r"\."), lambda p: p.cast("int")))


def is_newer(latest: Column, current: Column) -> Column:
    """Whether a version comes after another, missing parts being 0; null where one can't be read."""
    a, b = version_numbers(latest), version_numbers(current)
    n = F.greatest(F.size(a), F.size(b))
    pad = lambda v: F.concat(v, F.array_repeat(F.lit(0), n - F.size(v)))
    return F.when(a.isNotNull() & b.isNotNull(), pad(a) > pad(b))


def checksum_line(x: Column) -> Column:
    """The SHA-256 in the first field of a line, in lower case, or null."""
    first = F.lower(F.split(strip(x), r"\s+")[0])
    return F.when(first.rlike("^[0-9a-f]{64}$"), first)


def is_time_of_day(x: Column) -> Column:
    return x.rlike(r"^([01]\d|2[0-3]):[0-5]\d$")


def scattered_minute(host: Column) -> Column:
    """A time from 06:00 to 06:59 that depends on a host's name: its bytes as a number to base 31, in 32 bits."""
    codes = F.transform(F.regexp_extract_all(F.hex(F.encode(host, "UTF-8")), F.lit("(..)"), F.lit(1)), lambda h: F.conv(h, 16, 10).cast("long"))
    value = F.aggregate(codes, F.lit(0).cast("long"), lambda acc, c: F.pmod(acc * 31 + c, F.lit(1 << 32)))
    return F.format_string("06:%02d", F.pmod(value, F.lit(60)).cast("int"))


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, cut; 0 of nothing."""
    return F.when(whole <= 0, 0).otherwise((part * 100 / whole).cast("int"))


def finite(x: Column) -> Column:
    """x where it is a number, null for NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def reset_time(x: Column) -> Column:
    """A time from seconds since 1970 or an ISO text, UTC where it names no zone; null otherwise."""
    return F.coalesce(F.timestamp_seconds(x.try_cast("double")), F.try_to_timestamp(x))


def bar(value: Column, width: int = 20) -> Column:
    """A bar of # for 0 to 100 percent."""
    n = F.round(F.greatest(F.lit(0), F.least(F.lit(100), value)) / 100 * width).cast("int")
    return F.rpad(F.repeat(F.lit("#"), n), width, ".")


def is_mojibake(line: Column) -> Column:
    """Whether a line of text shows UTF-8 that was read as Latin-1."""
    return line.rlike("[ÃÂâ][\u0080-¿€™œžŸ]|�")


def folder_key(path: Column) -> Column:
    """A path for comparisons: forward slashes, no dots or doubled slashes, lower case."""
    flat = F.regexp_replace(F.replace(strip(path), F.lit("\\"), F.lit("/")), r"/(\./)+|/{2,}", "/")
    return F.lower(F.regexp_replace(flat, r"/\.?$", ""))


def path_under(base: Column, path: Column) -> Column:
    """path as it is where absolute, else under base."""
    return F.when(path.rlike(r"^(/|\\|[A-Za-z]:[\\/])"), path).otherwise(F.concat_ws("/", F.regexp_replace(base, "/+$", ""), path))


def since(moment: Column, now: Column) -> Column:
    """How long ago a moment was, in words; from a week on, its date."""
    seconds = F.timestamp_diff("SECOND", moment, now)
    n = lambda unit: F.floor(seconds / unit).cast("string")
    return (
        F.when(seconds < 120, "just now")
        .when(seconds < 3600, F.concat(n(60), F.lit(" minutes ago")))
        .when(seconds < 7200, "1 hour ago")
        .when(seconds < 86400, F.concat(n(3600), F.lit(" hours ago")))
        .when(seconds < 2 * 86400, "yesterday")
        .when(seconds < 7 * 86400, F.concat(n(86400), F.lit(" days ago")))
        .otherwise(F.date_format(moment, "d MMM yyyy"))
    )


def remaining(seconds: Column) -> Column:
    """A time that is left, in words and rounded down; an empty text when it is over."""
    n = lambda unit: F.floor(seconds / unit).cast("string")
    return (
        F.when(seconds <= 0, "")
        .when(seconds < 120, "under a minute")
        .when(seconds < 3600, F.concat(n(60), F.lit(" minutes")))
        .when(seconds < 7200, "1 hour")
        .when(seconds < 48 * 3600, F.concat(n(3600), F.lit(" hours")))
        .otherwise(F.concat(n(86400), F.lit(" days")))
    )


def content_length(headers: Column) -> Column:
    """The content-length of a map of headers, its name in any case; 0 without one or where it is no number."""
    found = F.map_values(F.map_filter(headers, lambda k, _: F.lower(k) == "content-length"))
    value = strip(F.coalesce(F.get(found, F.lit(0)), F.lit("")))
    return F.coalesce(F.when(value.rlike(r"^\d+$"), value.try_cast("long")), F.lit(0).cast("long"))
