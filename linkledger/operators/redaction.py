"""Messages without credentials, for a status and for a log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: What is redacted, what replaces it, and the bytes that a message may have.
HEADER = r"(?i)\b(cookie|set-cookie|authorization|bearer)\s*[:=]\s*\S+"
TOKEN = r"[A-Za-z0-9+/_\-]{32,}"
STATE_MARKERS = ['"cookies"', '"localstorage"', '"storagestate"', "jsessionid", "set-cookie"]
STATE_MESSAGE = "sync failed (error details omitted: the underlying message looked like it might contain session/cookie data)"
NOTHING, CUT, MOST = "no further detail available", "... [truncated]", 500
URL = r"""https?://[^\s"'<>)\]]+"""
PROTECTED = "\x01(.*?)\x02"


def _first_bytes(x: Column, n: int) -> Column:
    """The first n bytes of a text, an incomplete character at the end left out."""
    cut = F.substring(F.encode(x, "UTF-8"), F.lit(1), F.lit(n))
    return F.decode(F.unhex(F.regexp_replace(F.hex(cut), "((?:[CD].)|(?:E.(?:[89AB].)?)|(?:F.(?:[89AB].){0,2}))$", "")), "UTF-8")


def _spotless(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, HEADER, "$1: [redacted]"), TOKEN, "[redacted]")


def _finished(x: Column) -> Column:
    return T.bind(T.strip(x), lambda y: F.when(y == "", NOTHING).when(F.octet_length(y) > MOST, F.concat(_first_bytes(y, MOST), F.lit(CUT))).otherwise(y))


def sanitize(message: Column) -> Column:
    """A message fit for a status: headers and long tokens redacted, of bounded length, never blank."""
    return F.when(T.bind(F.lower(message), lambda m: T.contains_any(m, STATE_MARKERS)), STATE_MESSAGE).otherwise(_finished(_spotless(message)))


def scrub(message: Column) -> Column:
    """A message fit for a log: as sanitize, but addresses keep their path, and protected parts stay.

    Addresses and protected parts change places with short markers before redaction.
    """
    lifted = rf"{URL}|{PROTECTED}"
    kept = F.transform(F.regexp_extract_all(message, F.lit(lifted), F.lit(0)), lambda u: F.when(u.startswith("\x01"), F.regexp_replace(u, "[\x01\x02]", "")).otherwise(F.regexp_replace(u, r"[?#].*$", "?...")))
    bare = F.regexp_replace(message, lifted, "\x00")
    clean = sanitize(bare)
    pieces = F.split(clean, "\x00", -1)
    back = F.zip_with(pieces, F.slice(kept, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p, u: F.concat(F.coalesce(p, F.lit("")), F.coalesce(u, F.lit(""))))
    return F.array_join(back, "")


def protect(x: Column) -> Column:
    """A part of a message that scrub leaves as it is."""
    return F.concat(F.lit("\x01"), x, F.lit("\x02"))


def without_marks(x: Column) -> Column:
    return F.regexp_replace(x, PROTECTED, "$1")


def redact_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' texts as messages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return docs.select("doc_id", sanitize(F.col("text")).alias("message"))


QUERIES = {"redact_messages": redact_messages}
_STATE = " OR ".join(f"contains(lower(text), '{m}')" for m in STATE_MARKERS)
ORACLES = {
    # the most characters that have MOST bytes at most
    "redact_messages": rf"""
        WITH c AS (SELECT doc_id, {_STATE} AS state, regexp_replace(regexp_replace(text, '\b(cookie|set-cookie|authorization|bearer)\s*[:=]\s*\S+', '\1: [redacted]', 'gi'), '[A-Za-z0-9+/_\-]{{32,}}', '[redacted]', 'g') AS t FROM documents),
        s AS (SELECT doc_id, state, regexp_replace(t, '^[\s\pZ]+|[\s\pZ]+$', '', 'g') AS t FROM c)
        SELECT doc_id, CASE WHEN state THEN '{STATE_MESSAGE}' WHEN t = '' THEN '{NOTHING}'
            WHEN strlen(t) > {MOST} THEN left(t, list_max(list_filter(range(1, {MOST} + 1), lambda n: strlen(left(t, n)) <= {MOST}))) || '{CUT}' ELSE t END AS message FROM s""",
}
