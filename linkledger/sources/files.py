"""Reading parts of files: the ends of logs, and the entries of archives, each planned so that no task reads a whole large file.

Files are opened where they are, by pyarrow's file systems, so paths may be addresses of
any store that it knows.
"""

from __future__ import annotations

import uuid
import zipfile
from collections.abc import Iterator
from contextlib import ExitStack
from dataclasses import dataclass
from datetime import datetime

import numpy as np
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Bytes and lines of a log's end.
TAIL_BYTES, TAIL_LINES = 256 << 10, 400
#: Bytes that a task reads, about: small files and entries are read together up to that.
EACH = 64 << 20
#: Tasks in which small files are read together hold so many at most.
TOGETHER = 256


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def sizes(path: str, ending: str) -> list[tuple[str, int]]:
    """(file, bytes) of a file, or of a folder's files at any depth, by name; hidden ones and markers are left out."""
    files, root = opened(path)
    found = files.get_file_info(root)
    if found.type == fs.FileType.File:
        return [(root, found.size)]
    inside = files.get_file_info(fs.FileSelector(root, recursive=True))
    return sorted((i.path, i.size) for i in inside if i.type == fs.FileType.File and i.path.endswith(ending) and not any(p[:1] in "._" for p in i.path[len(root) :].split("/") if p))


class Work(InputPartition):
    """What one task reads: (file, and what of it)."""

    def __init__(self, parts: list[tuple]) -> None:
        self.parts = parts


def packed(parts: list[tuple], weights: list[int], each: int) -> list[Work]:
    """Parts in turn, together up to `each` bytes or TOGETHER of them; a larger one is alone."""
    out, held, total = [], [], 0
    for part, weight in zip(parts, weights, strict=True):
        if held and (total + weight > each or len(held) == TOGETHER):
            out.append(Work(held))
            held, total = [], 0
        held.append(part)
        total += weight
    return [*out, Work(held)] if held or not out else out


def tail(data: bytes, cut: bool, lines: int) -> tuple[list[str], bool]:
    """The last lines of a log's last bytes, and whether anything is missing. If the bytes begin within a file, what stands before their first line end is no whole line."""
    if cut and b"\n" in data:
        data = data.partition(b"\n")[2]
    found = data.rstrip(b"\n").split(b"\n") if data.rstrip(b"\n") else []
    return [line.decode(errors="replace") for line in found[-lines:]], cut or len(found) > lines


class LogTail(DataSource):
    """Format `log_tail`: the last lines of each log. Options: path, of a file or folder; ending ("" takes all files); bytes and lines of each.

    Written are logs of rows (a file's name, a line) below the folder `path`, a file for each
    name. A name's rows are to be one partition's, in turn and in the order of the lines.
    """

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "path string, number int, line string, truncated boolean"

    def reader(self, schema) -> DataSourceReader:
        return _Tails(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Logs(self.options["path"])


@dataclass
class Written(WriterCommitMessage):
    """The folder that a task's logs are in."""

    folder: str


class _Logs(DataSourceArrowWriter):
    """Each task writes its logs in a hidden folder of its own; the driver shows those of the tasks that count, a folder each and not a file."""

    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator) -> Written:
        files, root = opened(self.path)
        folder = uuid.uuid4().hex
        files.create_dir(f"{root}/_{folder}")
        last, out = None, None
        with ExitStack() as stack:
            for batch in iterator:
                names, lines = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
                starts = np.flatnonzero(np.r_[True, names[1:] != names[:-1]][: len(names)])
                for begin, end in zip(starts, [*starts[1:], len(names)], strict=True):
                    if names[begin] != last:
                        stack.close()
                        last, out = names[begin], stack.enter_context(files.open_output_stream(f"{root}/_{folder}/{names[begin]}"))
                    out.write("".join(f"{line}\n" for line in lines[begin:end]).encode())
        return Written(folder)

    def commit(self, messages: list) -> None:
        files, root = opened(self.path)
        files.create_dir(root)
        for m in messages:
            if m is not None:
                files.move(f"{root}/_{m.folder}", f"{root}/{m.folder}")


class _Tails(DataSourceReader):
    def __init__(self, options) -> None:
        self.path, self.ending = options["path"], options.get("ending", "")
        self.bytes, self.lines = int(options.get("bytes", TAIL_BYTES)), int(options.get("lines", TAIL_LINES))

    def partitions(self) -> list[Work]:
        found = sizes(self.path, self.ending)
        return packed(found, [min(n, self.bytes) for _, n in found], EACH)

    def read(self, partition: Work) -> Iterator[tuple]:
        files, _ = opened(self.path)
        for name, size in partition.parts:
            begin = max(0, size - self.bytes)
            with files.open_input_file(name) as f:
                data = f.read_at(size - begin, begin)
            lines, missing = tail(data, begin > 0, self.lines)
            for n, line in enumerate(lines, 1):
                yield name, n, line, missing


class Seeking:
    """An opened file as archives want it: a place before its beginning is an OSError."""

    def __init__(self, file) -> None:
        self.file, self.read, self.tell = file, file.read, file.tell

    def seekable(self) -> bool:
        return True

    def seek(self, place: int, whence: int = 0) -> int:
        try:
            return self.file.seek(place, whence)
        except ValueError as error:
            raise OSError(str(error)) from error


class ZipEntries(DataSource):
    """Format `zip_entries`: the files in archives, by their base names. Options: path, of an archive or folder; ending (.zip); each, the bytes that a task reads, about.

    Archives above `each` are planned from their central directory, so one large archive is
    many tasks; smaller ones are read together, and aren't opened before. Time is as archives
    have it, without zone, and taken as UTC.
    """

    @classmethod
    def name(cls) -> str:
        return "zip_entries"

    def schema(self) -> str:
        return "path string, entry int, name string, modified timestamp, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _Entries(self.options)


class _Entries(DataSourceReader):
    def __init__(self, options) -> None:
        self.path, self.ending, self.each = options["path"], options.get("ending", ".zip"), int(options.get("each", EACH))

    def partitions(self) -> list[Work]:
        files, _ = opened(self.path)
        found = sizes(self.path, self.ending)
        small = [(name, None) for name, n in found if n <= self.each]
        work = packed(small, [n for _, n in found if n <= self.each], self.each) if small or not found else []
        for name, _ in ((f, n) for f, n in found if n > self.each):
            with files.open_input_file(name) as f, zipfile.ZipFile(Seeking(f)) as archive:
                inside = [(k, max(i.file_size, i.compress_size)) for k, i in enumerate(archive.infolist()) if not i.is_dir()]
            for piece in packed([k for k, _ in inside], [n for _, n in inside], self.each):
                work.append(Work([(name, piece.parts)]))
        return work

    def read(self, partition: Work) -> Iterator[tuple]:
        files, _ = opened(self.path)
        for name, wanted in partition.parts:
            with files.open_input_file(name) as f, zipfile.ZipFile(Seeking(f)) as archive:
                inside = archive.infolist()
                for k in range(len(inside)) if wanted is None else wanted:
                    if not inside[k].is_dir():
                        yield name, k, inside[k].filename.rpartition("/")[2], datetime(*inside[k].date_time), archive.read(inside[k])


def log_tails(spark: SparkSession, path: str, **options: str | int) -> DataFrame:
    """(path, number, line, truncated) of the ends of logs; options as LogTail has them."""
    spark.dataSource.register(LogTail)
    return spark.read.format("log_tail").options(path=path, **options).load()


def write_logs(rows: DataFrame, path: str, name: str, order: str, line: str) -> None:
    """A log for each name below a new folder, with its lines in order."""
    rows.sparkSession.dataSource.register(LogTail)
    rows.repartition(name).sortWithinPartitions(name, order).select(name, line).write.format("log_tail").mode("append").save(path)


def archive_entries(spark: SparkSession, path: str, **options: str | int) -> DataFrame:
    """(path, entry, name, modified, content) of the files in archives; options as ZipEntries has them."""
    spark.dataSource.register(ZipEntries)
    return spark.read.format("zip_entries").options(path=path, **options).load()


QUERY_BYTES, QUERY_LINES = 2000, 30


def log_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ends of users' logs, one file of all events of each user."""
    from .tables import checkpoint_folder

    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(F.lit("user_id="), "user_id", F.lit(".txt")).alias("log"), "event_id", F.concat_ws(" ", F.col("event_id").cast("string"), "event_type", "props", F.when(F.col("event_id") % 3 == 0, "é")).alias("line"))
    path = f"{checkpoint_folder(spark)}/logs-{uuid.uuid4().hex}"
    write_logs(e, path, "log", "event_id", "line")
    found = log_tails(spark, path, ending=".txt", bytes=QUERY_BYTES, lines=QUERY_LINES)
    return found.select(F.regexp_extract("path", r"user_id=(\d+)", 1).cast("long").alias("user_id"), "number", "line", "truncated")


QUERIES = {"log_ends": log_ends}
ORACLES = {
    "log_ends": f"""
        WITH l AS (SELECT user_id, event_id, event_id::VARCHAR || ' ' || event_type || ' ' || props || CASE WHEN event_id % 3 = 0 THEN ' é' ELSE '' END AS line FROM events),
        c AS (SELECT *, sum(strlen(line) + 1) OVER (PARTITION BY user_id ORDER BY event_id DESC) AS upto, sum(strlen(line) + 1) OVER (PARTITION BY user_id) AS size, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back FROM l),
        k AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM c WHERE size <= {QUERY_BYTES} OR upto < {QUERY_BYTES})
        SELECT user_id, (least(n, {QUERY_LINES}) - back + 1)::INT AS number, line, size > {QUERY_BYTES} OR n > {QUERY_LINES} AS truncated FROM k WHERE back <= {QUERY_LINES}"""
}
