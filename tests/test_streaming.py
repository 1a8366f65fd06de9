"""Live stall warnings, and the event log as a stream that is stopped and goes on."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from linkledger.streaming import event_log, stalls

START = datetime(2024, 1, 1)
EVENT = "run string, ts timestamp, course string, section string, url string, ended boolean"


def warned(spark, tmp_path, files, late="0 seconds", **how):
    """What a stream tells of events by run and second, a micro-batch for each file."""
    for k, rows in enumerate(files):
        data = [(run, START + timedelta(seconds=at), *(more + [None] * 4)[:4]) for run, at, *more in rows]
        spark.createDataFrame(data, EVENT).coalesce(1).write.mode("append").json(str(tmp_path / f"in/{k:03d}"))
    events = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in/*"))
    stream = stalls.stall_warnings(events, late=late, **how).writeStream.format("memory").queryName("warned").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    try:
        stream.processAllAvailable()
    finally:
        stream.stop()
    return sorted((r["run"], round((r["at"] - START).total_seconds()), r["quiet_seconds"], r["warning"], r["course"], r["section"]) for r in spark.table("warned").collect())


@pytest.fixture
def timers(spark):
    kind = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(kind)
    yield stalls.with_timers(spark)
    spark.conf.set(kind, before)


def test_warnings_while_a_run_is_quiet(timers, tmp_path):
    files = [[("a", 0, "Algebra", "One"), ("b", 0)], [("b", 100)], [("b", 200)], [("b", 250)], [("a", 255, None, "Two")], [("b", 400)], [("b", 440)], [("b", 450)]]
    got = warned(timers, tmp_path, files)
    assert got == [("a", 180, 180, 1, "Algebra", "One"), ("a", 210, 210, 2, "Algebra", "One"), ("a", 240, 240, 3, "Algebra", "One"), ("a", 435, 180, 4, "Algebra", "Two")]


def test_runs_that_end_or_are_given_up_are_forgotten(timers, tmp_path):
    files = [[("a", 0), ("b", 0), ("c", 0), ("x", 0)], [("a", 10, None, None, None, True), ("x", 190)], [("x", 370)], [("x", 540)], [("b", 545)], [("x", 600)]]
    got = warned(timers, tmp_path, files, give_up=240)
    # a ended; b and c are given up after 240 seconds; b begins anew
    assert [r[:4] for r in got] == [("b", 180, 180, 1), ("b", 210, 210, 2), ("b", 240, 240, 3), ("c", 180, 180, 1), ("c", 210, 210, 2), ("c", 240, 240, 3)] + [("x", 180, 180, 1)]


def test_events_in_any_order_within_a_batch(timers, tmp_path):
    files = [[("a", 400, "", "Late"), ("a", 0, "Algebra", "One"), ("a", 150), ("a", 165, None, "Two")], [("b", 700, None, None, None, True), ("b", 100), ("b", 50), ("a", 402)]]
    got = warned(timers, tmp_path, files)
    # a: quiet from 165 to 400, told with what was known then; b: quiet from 100 to its end
    assert [r for r in got if r[0] == "a" and r[1] < 402] == [("a", 345, 180, 1, "Algebra", "Two"), ("a", 375, 210, 2, "Algebra", "Two")]
    assert [r[1] for r in got if r[0] == "b"] == list(range(280, 700, 30))


def events(spark, a, b):
    return spark.range(a, b, 1, 3).select(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("time"), F.lit("file").alias("kind"), F.col("id").cast("string").alias("file"), F.when(F.col("id") % 3 == 0, 'é "quoted"\nline').alias("message"), "id")


def delivered(spark, path, to, **options):
    """Runs a stream from the log to a table until it has all, and stops it."""
    source = event_log.registered(spark).readStream.format("event_log").option("path", path).options(**options).load()
    stream = source.writeStream.format("parquet").option("path", f"{to}/out").option("checkpointLocation", f"{to}/c").start()
    try:
        stream.processAllAvailable()
    finally:
        stream.stop()
    return [(r["job"], r["seq"], r["file"]) for r in spark.read.parquet(f"{to}/out").collect()]


def test_a_stream_stopped_and_restarted_loses_and_repeats_nothing(spark, tmp_path):
    path, to = f"file://{tmp_path}/log", str(tmp_path / "one")
    job = event_log.start_job(path)
    assert event_log.publish(events(spark, 0, 500), path, job, ["id"], each=60) == 500
    one = [(1, k + 1, str(k)) for k in range(500)]
    assert sorted(delivered(spark, path, to)) == one
    assert event_log.publish(events(spark, 500, 700), path, job, ["id"]) == 700
    assert event_log.start_job(path) == 2  # while nobody reads
    event_log.publish(events(spark, 0, 50), path, 2, ["id"])
    assert event_log.start_job(path) == 3
    event_log.publish(events(spark, 7, 9), path, 3, ["id"])
    rest = [(1, k + 1, str(k)) for k in range(500, 700)] + [(2, k + 1, str(k)) for k in range(50)] + [(3, 1, "7"), (3, 2, "8")]
    assert sorted(delivered(spark, path, to)) == one + rest
    assert sorted(delivered(spark, path, to)) == one + rest  # nothing new
    # one who comes late gets the running job's whole history, another one goes on from what it saw
    assert sorted(delivered(spark, path, str(tmp_path / "late"))) == rest[-2:]
    assert sorted(delivered(spark, path, str(tmp_path / "seen"), job="1", after="650")) == [r for r in rest if r[0] > 1 or r[1] > 650]
    event_log.forget(path, 3)
    assert event_log.jobs(path) == [3]


def test_logs_in_batches(spark, tmp_path):
    path = str(tmp_path / "log")
    read = lambda **o: event_log.registered(spark).read.format("event_log").option("path", path).options(**o).load()
    assert read().count() == 0
    job = event_log.start_job(path)
    assert event_log.publish(events(spark, 0, 0), path, job, ["id"]) == 0 and read().count() == 0
    event_log.publish(events(spark, 0, 10), path, job, ["id"])
    row = read(after="3").orderBy("seq").first()
    assert (row["seq"], row["file"], row["message"], row["course"], row["time"]) == (4, "3", 'é "quoted"\nline', None, datetime.fromtimestamp(1_700_000_003))
    assert read(after="10").count() == 0


def test_what_no_commit_names_is_not_read(spark, tmp_path):
    path = str(tmp_path / "log")
    job = event_log.start_job(path)
    event_log.publish(events(spark, 0, 5), path, job, ["id"])
    (tmp_path / "log/job-0000000001/events-00000000000000000006-00000000000000000009-dead.jsonl").write_text('{"seq": 6, "time": null}\n')
    assert event_log.registered(spark).read.format("event_log").option("path", path).load().count() == 5
    assert event_log.publish(events(spark, 5, 9), path, job, ["id"]) == 9
