"""Reading and writing the state of runs: records, visits, histories, logs, archives and tables of other programs."""

from __future__ import annotations

import io
import tempfile
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RECORD = "struct<size:bigint,modified:string,fail_count:int,failed_at:string,unverified:boolean>"
STATE = f"schema_version int, updated_at string, files map<string,{RECORD}>"
VISITS = "course string, section_title string, section_url string, files_found int, timestamp timestamp, had_children boolean"
STATUS = "timestamp timestamp, outcome string, message string, files_downloaded int, files_skipped int, files_errored int, login_path string"
#: The scheme of keys that is written now; files without a number are of the first.
SCHEME = 2
CELL = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the session names; a folder of our own only where one machine is all there is, as in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def ranges(df: DataFrame, order: list[str], each: int = 100_000) -> DataFrame:
    """df, cut, in ranges of an order of about `each` rows: _part is the number of a row's range."""
    n = max(1, -(-df.count() // each))
    return cut(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))


def in_order(df: DataFrame, order: list[str], name: str, each: int = 100_000) -> DataFrame:
    """df with its rows numbered from 0 in an order; only a count for each range of it meets in one task."""
    placed = ranges(df, order, each)
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = placed.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", before.alias("_before"))
    return placed.join(F.broadcast(heads), "_part").withColumn(name, F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1).drop("_part", "_before")


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """(key, size, modified, fail_count, failed_at, unverified, schema_version) of a state's JSON file; no file, no rows.

    Where a key comes twice, JSON's last one counts. A file without scheme number is of scheme 1.
    """
    try:
        whole = spark.read.schema(STATE).json(path, multiLine=True)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        whole = spark.createDataFrame([], STATE)
    rows = whole.select(F.coalesce("schema_version", F.lit(1)).alias("schema_version"), F.explode("files").alias("key", "r"))
    return rows.select("key", "r.size", "r.modified", F.coalesce("r.fail_count", F.lit(0)).alias("fail_count"), "r.failed_at", F.coalesce("r.unverified", F.lit(False)).alias("unverified"), "schema_version")


def write_state(state: DataFrame, path: str) -> None:
    """A state as a new snapshot, sorted by key; snapshots are never changed in place."""
    state.withColumn("schema_version", F.lit(SCHEME)).repartitionByRange("key").sortWithinPartitions("key").write.json(path)


def read_lines(spark: SparkSession, path: str, schema: str, needed: str) -> DataFrame:
    """Rows of a file of JSON lines; blank and corrupt lines, and those without the needed column, are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*").where(F.col(needed).isNotNull() & (F.col(needed) != ""))


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return read_lines(spark, path, STATUS, "outcome")


def read_visits(spark: SparkSession, path: str) -> DataFrame:
    """Visits of JSON arrays, or of JSON lines."""
    return spark.read.schema(VISITS).json(path, multiLine=True)


def append_visits(visits: DataFrame, path: str) -> None:
    visits.write.mode("append").json(path)


def log_tail(lines: DataFrame, number: str, most: int) -> tuple[DataFrame, bool]:
    """The last lines by number, and whether there are more."""
    newest = lines.orderBy(F.desc(number)).limit(most + 1)
    tail = newest.orderBy(F.desc(number)).limit(most)
    return tail.orderBy(number), lines.limit(most + 1).count() > most


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha256, is_pdf) of whole files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), (F.substring("content", 1, 4) == F.lit(b"%PDF")).alias("is_pdf"))


def zip_entries(archives: DataFrame) -> DataFrame:
    """(path, name, modified, content) of the files in archives (path, content), by their base names."""

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for info in archive.infolist():
                        if not info.is_dir():
                            yield pd.DataFrame({"path": [path], "name": [info.filename.rpartition("/")[2]], "modified": [pd.Timestamp(*info.date_time)], "content": [archive.read(info)]})

    return archives.select("path", "content").mapInPandas(entries, "path string, name string, modified timestamp, content binary")


def _column(reference: str) -> int:
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def xlsx_rows(books: DataFrame) -> DataFrame:
    """(path, row, cells) of the first sheet of workbooks (path, content): cells by column number, missing ones empty."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as book:
                    shared = []
                    if "xl/sharedStrings.xml" in book.namelist():
                        shared = ["".join(t.text or "" for t in si.iter(f"{CELL}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{CELL}si")]
                    for n, row in enumerate(ElementTree.fromstring(book.read("xl/worksheets/sheet1.xml")).iter(f"{CELL}row")):
                        cells: dict[int, str] = {}
                        for c in row.iter(f"{CELL}c"):
                            value = c.findtext(f"{CELL}v") or "".join(t.text or "" for t in c.iter(f"{CELL}t"))
                            cells[_column(c.get("r", "A"))] = shared[int(value)] if c.get("t") == "s" and value else value
                        yield pd.DataFrame({"path": [path], "row": [n], "cells": [[cells.get(k, "") for k in range(max(cells, default=-1) + 1)]]})

    return books.select("path", "content").mapInPandas(rows, "path string, row int, cells array<string>")


def write_tsv(rows: DataFrame, path: str, columns: list[str]) -> None:
    """Distinct rows in order, as tab-separated files."""
    rows.select(columns).distinct().repartitionByRange(*columns).sortWithinPartitions(*columns).write.csv(path, sep="\t", header=True)


def bounded_history(history: DataFrame, new: DataFrame, most: int = 30) -> DataFrame:
    """The latest rows of a history with new ones."""
    both = history.unionByName(new, allowMissingColumns=True)
    return both.orderBy(F.desc("timestamp")).limit(most)


def assets_of(releases: DataFrame, body: str, name: str) -> DataFrame:
    """(tag, url, download_url, size) of releases' JSON: the asset of a name, null where a release has none."""
    r = F.from_json(body, "tag_name string, html_url string, assets array<struct<name:string,browser_download_url:string,size:bigint>>")
    one = F.get(F.filter(F.col("r.assets"), lambda a: a["name"] == name), F.lit(0))
    return releases.select(r.alias("r")).select(F.col("r.tag_name").alias("tag"), F.col("r.html_url").alias("url"), one["browser_download_url"].alias("download_url"), one["size"].alias("size"))
