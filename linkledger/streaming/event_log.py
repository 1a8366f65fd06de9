"""The events of jobs as a log that can be read on from any sequence number, as a batch or as a stream.

A log is a folder with a folder for each job. Publishing writes files of whole ranges of
sequence numbers, and then one commit that names them; what no commit names is not there,
so a task that ran twice or died halfway leaves nothing that is read. Names say which
numbers a file has, so a reader plans its work from names alone: a partition for each file.

A stream's offset is a job and a sequence number. A job that starts has a new, empty log;
streams first deliver what is left of the job before it, so a stream that was stopped loses
and repeats nothing. There is no buffer that a slow reader could overflow.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.window import Window

from ..sources.files import opened
from ..sources.tables import cut

SCHEMA = "job long, seq long, time timestamp, kind string, course string, file string, message string, error string"
FIELDS = ["kind", "course", "file", "message", "error"]
#: Events of a file, about.
EACH = 50_000
_JOB = re.compile(r"job-(\d{10})$")
_COMMIT = re.compile(r"commit-(\d{20})-(\d{20})\.json$")


def _names(files: fs.FileSystem, folder: str) -> list[str]:
    return sorted(i.path for i in files.get_file_info(fs.FileSelector(folder, allow_not_found=True)))


def _written(files: fs.FileSystem, path: str, data: bytes) -> None:
    """The file as a whole or not at all."""
    beside = f"{path}.{uuid.uuid4().hex}.tmp"
    with files.open_output_stream(beside) as out:
        out.write(data)
    files.move(beside, path)


def jobs(path: str) -> list[int]:
    files, root = opened(path)
    return sorted(int(m[1]) for p in _names(files, root) if (m := _JOB.search(p)))


def start_job(path: str) -> int:
    """A new job's number; its log is empty. Logs of earlier jobs stay until forget() takes them."""
    files, root = opened(path)
    job = max(jobs(path), default=0) + 1
    files.create_dir(f"{root}/job-{job:010d}", recursive=True)
    return job


def forget(path: str, before: int) -> None:
    """Deletes the logs of jobs before a job; a stream that hasn't read them goes on with that job."""
    files, root = opened(path)
    for job in jobs(path):
        if job < before:
            files.delete_dir(f"{root}/job-{job:010d}")


def commits(path: str, job: int) -> list[tuple[int, int, str]]:
    """(first, last, file) of a job's commits, in order."""
    files, root = opened(path)
    return [(int(m[1]), int(m[2]), p) for p in _names(files, f"{root}/job-{job:010d}") if (m := _COMMIT.search(p))]


def last_seq(path: str, job: int) -> int:
    return max((last for _, last, _ in commits(path, job)), default=0)


def publish(events: DataFrame, path: str, job: int, order: list[str], each: int = EACH) -> int:
    """Appends events (time and FIELDS, those of `order` too) to a job's log, numbered on in their order; returns the last number.

    Events are dealt to ranges of their order. Only one row for each range, how many it has,
    meets in a single task. One publisher of a job at a time: a second one's commit of the
    same numbers fails.
    """
    files, root = opened(path)
    folder, begin = f"{root}/job-{job:010d}", last_seq(path, job)
    kept = [c for c in dict.fromkeys(["time", *FIELDS, *order]) if c in events.columns]
    n = max(1, -(-events.count() // each))
    placed = cut(events.select(kept).repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_nth", F.monotonically_increasing_id()))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_nth").alias("_from"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = sizes.select("_part", "_from", before.alias("_before"))
    values = [F.col(c) if c in kept else F.lit(None).cast("string").alias(c) for c in ["time", *FIELDS]]
    numbered = placed.join(F.broadcast(heads), "_part").select((F.lit(begin + 1) + F.col("_before") + F.col("_nth") - F.col("_from")).alias("seq"), *values)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, where = opened(path)
        held = [batch for batch in batches if len(batch)]  # a range: some `each` events
        if held:
            rows = pd.concat(held).sort_values("seq")
            first, last = int(rows["seq"].iloc[0]), int(rows["seq"].iloc[-1])
            name = f"events-{first:020d}-{last:020d}-{uuid.uuid4().hex[:8]}.jsonl"
            lines = [json.dumps({"seq": int(seq), "time": None if pd.isna(time) else time.isoformat(), **{f: v for f, v in zip(FIELDS, texts, strict=True) if v is not None}}, ensure_ascii=False) for seq, time, *texts in rows[["seq", "time", *FIELDS]].itertuples(index=False)]
            _written(own, f"{where}/job-{job:010d}/{name}", ("\n".join(lines) + "\n").encode())
            yield pd.DataFrame({"first": [first], "last": [last], "name": [name]})

    parts = sorted((r["first"], r["last"], r["name"]) for r in numbered.mapInPandas(write, "first long, last long, name string").collect())  # a row for each file
    if not parts:
        return begin
    if [p[0] for p in parts[1:]] != [p[1] + 1 for p in parts[:-1]] or parts[0][0] != begin + 1:
        raise RuntimeError("the written ranges don't follow one another")
    if last_seq(path, job) != begin:
        raise RuntimeError("the job's log has grown meanwhile")
    _written(files, f"{folder}/commit-{begin + 1:020d}-{parts[-1][1]:020d}.json", json.dumps(parts).encode())
    return parts[-1][1]


class Piece(InputPartition):
    """The events of one file with numbers from `first` to `last`."""

    def __init__(self, job: int, first: int, last: int, file: str) -> None:
        self.job, self.first, self.last, self.file = job, first, last, file


def pieces(path: str, job: int, after: int, upto: int) -> list[Piece]:
    """What of a job's files has the numbers after one and up to another."""
    files, _ = opened(path)
    out = []
    for first, last, commit in commits(path, job):
        if last > after and first <= upto:
            with files.open_input_stream(commit) as f:
                named = json.loads(f.read())
            folder = commit.rpartition("/")[0]
            out += [Piece(job, max(a, after + 1), min(b, upto), f"{folder}/{name}") for a, b, name in named if b > after and a <= upto]
    return out


def _events(path: str, piece: Piece) -> Iterator[tuple]:
    files, _ = opened(path)
    with files.open_input_stream(piece.file) as f:
        for line in f.read().decode().splitlines():  # `each` events at most
            event = json.loads(line)
            if piece.first <= event["seq"] <= piece.last:
                yield (piece.job, event["seq"], pd.Timestamp(event["time"]).to_pydatetime() if event["time"] else None, *(event.get(f) for f in FIELDS))


class EventLog(DataSource):
    """Format `event_log`. Options: path; job (the newest one at the start); after, the number of the last event that was seen (0)."""

    @classmethod
    def name(cls) -> str:
        return "event_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


class _Batch(DataSourceReader):
    """One job's events."""

    def __init__(self, options) -> None:
        self.path, self.job, self.after = options["path"], options.get("job"), int(options.get("after", "0"))

    def partitions(self) -> list[Piece]:
        job = int(self.job) if self.job else max(jobs(self.path), default=0)
        return pieces(self.path, job, self.after, last_seq(self.path, job)) or [Piece(job, 1, 0, "")]

    def read(self, partition: Piece) -> Iterator[tuple]:
        return _events(self.path, partition) if partition.file else iter(())


class _Stream(DataSourceStreamReader):
    """A job's events, then those of the jobs that start after it."""

    def __init__(self, options) -> None:
        self.path, self.job, self.after = options["path"], options.get("job"), int(options.get("after", "0"))

    def initialOffset(self) -> dict:
        return {"job": int(self.job) if self.job else max(jobs(self.path), default=0), "seq": self.after}

    def latestOffset(self) -> dict:
        job = max(jobs(self.path), default=0)
        return {"job": job, "seq": last_seq(self.path, job)}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        if start == end:
            return []
        if start["job"] == end["job"]:
            return pieces(self.path, start["job"], start["seq"], end["seq"])
        whole = [(job, 0, last_seq(self.path, job)) for job in jobs(self.path) if start["job"] < job < end["job"]]
        return [p for job, after, upto in [(start["job"], start["seq"], last_seq(self.path, start["job"])), *whole, (end["job"], 0, end["seq"])] for p in pieces(self.path, job, after, upto)]

    def read(self, partition: Piece) -> Iterator[tuple]:
        return _events(self.path, partition)

    def commit(self, end: dict) -> None:
        """Nothing is taken away: other readers may come later."""


def registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(EventLog)
    return spark


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What viewers still get who saw 100 events: two jobs' logs, those of the first and the second half of the month, read back."""
    from ..sources.tables import checkpoint_folder

    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("time"), F.col("event_type").alias("kind"), F.col("user_id").cast("string").alias("course"), F.col("props").alias("message"), "event_id")
    path = f"{checkpoint_folder(spark)}/event-log-{uuid.uuid4().hex}"
    read = []
    for half in ("day(time) <= 15", "day(time) > 15"):
        job = start_job(path)
        publish(e.where(half), path, job, ["time", "event_id"])
        read.append(registered(spark).read.format("event_log").option("path", path).option("job", str(job)).option("after", "100").load())
    return read[0].unionByName(read[1]).select("job", "seq", F.unix_micros("time").alias("at"), "kind", "course", "message")


QUERIES = {"event_log": event_log}
ORACLES = {
    "event_log": """
        WITH l AS (SELECT (day(ts) > 15)::INT + 1 AS job, ts, event_id, event_type, user_id, props FROM events),
        n AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY ts, event_id) AS seq FROM l)
        SELECT job::BIGINT AS job, seq, epoch_us(ts) AS at, event_type AS kind, user_id::VARCHAR AS course, props AS message FROM n WHERE seq > 100"""
}
