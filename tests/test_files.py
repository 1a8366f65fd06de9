"""Ends of logs, entries of archives, and states of which a run rewrites what it touches."""

import zipfile

import pytest
from pyspark.sql import functions as F

from linkledger.operators import changes
from linkledger.sources import files, states, tables


def plain_tail(data, most, lines):
    """As a program would that reads the end of one file."""
    cut = len(data) > most
    text = data[-most:] if cut else data
    if cut and b"\n" in text:
        text = text[text.index(b"\n") + 1 :]
    rows = text.rstrip(b"\n").split(b"\n")
    return [r.decode(errors="replace") for r in rows[-lines:] if rows != [b""]], cut or len(rows) > lines


@pytest.mark.parametrize("most, lines", [(100, 400), (37, 3), (1000, 5), (12, 400)])
def test_ends_of_logs(spark, tmp_path, most, lines):
    logs = {
        "a.log": b"".join(b"line %d\n" % k for k in range(30)),
        "sub/b.log": "kurz\nüü\n\n\n".encode(),
        "empty.log": b"",
        "one.log": b"no end of line " * 9,
        "exact.log": b"x" * 11 + b"\n" + b"second line\n" + b"y" * 88 + b"\n",
        "crlf.log": b"a\r\nb\r\n",
        "_SUCCESS": b"not a log\n",
    }
    for name, data in logs.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {}
    for r in files.log_tails(spark, f"file://{tmp_path}", bytes=most, lines=lines).orderBy("path", "number").collect():
        got.setdefault(r["path"].removeprefix(f"{tmp_path}/"), []).append((r["number"], r["line"], r["truncated"]))
    for name, data in logs.items():
        rows, missing = plain_tail(data, most, lines)
        assert got.get(name, []) == ([(n, r, missing) for n, r in enumerate(rows, 1)] if name != "_SUCCESS" else []), name


def test_a_large_archive_is_many_tasks(spark, tmp_path):
    for a, n in (("big.zip", 40), ("small.zip", 3), ("none.zip", 0)):
        with zipfile.ZipFile(tmp_path / a, "w") as z:
            for k in range(n):
                z.writestr(zipfile.ZipInfo(f"d/{a}{k}.txt", (2024, 1, 2, 3, 4, k)), bytes([k]) * 1000)
            if n:
                z.writestr("d/e/", b"")
    entries = files.archive_entries(spark, str(tmp_path), each=5000)
    sizes = entries.groupBy(F.spark_partition_id()).agg(F.sum(F.length("content")).alias("n")).collect()
    assert len(sizes) >= 8 and max(r["n"] for r in sizes) <= 5000
    old = tables.zip_entries(spark.read.format("binaryFile").load(str(tmp_path)))
    rows = lambda df: sorted((r["path"].removeprefix("file:"), r["name"], str(r["modified"]), bytes(r["content"])) for r in df.collect())
    assert rows(entries) == rows(old) and len(rows(old)) == 43
    assert entries.where("entry = 7").count() == 1


def test_a_run_rewrites_what_it_touches(spark, tmp_path):
    state = spark.range(400).select(F.concat(F.lit("k"), "id").alias("key"), F.lit(5).cast("long").alias("size"), F.lit("m").alias("modified"), F.lit(0).alias("fail_count"), F.lit(None).cast("string").alias("failed_at"), F.lit(False).alias("unverified"))
    states.create(state, "state_of_runs", f"{tmp_path}/state", parts=8)
    planned = spark.createDataFrame([("k7", 9, "n", "DOWNLOAD"), ("k8", 9, "n", "DOWNLOAD"), ("new", 1, None, "DOWNLOAD"), ("k9", 9, "n", "SKIP")], "key string, size long, modified string, action string")
    outcomes = spark.createDataFrame([("k7", "ok"), ("k8", "failed"), ("new", "ok")], "key string, status string")
    times = lambda: {p.parent.name + p.name: p.stat().st_mtime_ns for p in (tmp_path / "state").rglob("*.parquet")}
    before = times()
    plan = states.merged(spark, "state_of_runs", planned, outcomes, F.lit("now"))[0]._jdf.queryExecution().executedPlan().toString()
    # the state's side of the full join is read in its buckets
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "Bucketed: true" in scan and "PartitionFilters: [part" in scan and plan.count("hashpartitioning(key") <= 3
    touched = states.apply(spark, "state_of_runs", planned, outcomes, F.lit("now"))
    after = times()
    rewritten = {int(n.split("=")[1].split("part-")[0]) for n in before if n not in after}
    assert rewritten <= set(touched) and 0 < len(touched) <= 3
    want = {tuple(r) for r in changes.merge(state, planned, outcomes, F.lit("now")).collect()}
    assert {tuple(r) for r in spark.table("state_of_runs").select(states.COLUMNS).collect()} == want and len(want) == 401
    assert states.apply(spark, "state_of_runs", planned.where("false"), outcomes.where("false"), F.lit("now")) == []
    assert spark.table("state_of_runs").count() == 401
