"""What keeps queries in step with their input: what is computed once, and where."""

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F

from linkledger.functions import text as T
from linkledger.operators import addresses
from linkledger.plans import listing
from linkledger.sources import files

SF = "/root/testdata/sf0.001"


def test_links_of_pages_are_judged_where_they_are_computed(spark, monkeypatch):
    """Filters on links name computed columns instead of computing them anew; pages are many tasks'."""
    monkeypatch.setattr(addresses, "PAGES", 2)
    found = addresses.file_listing(spark, SF)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1 and max(len(x) for x in plan.splitlines() if "Filter" in x) < 10_000
    pages = addresses._supplier_pages(spark, SF)
    assert pages.rdd.getNumPartitions() == -(-pages.count() // 2)
    few = listing.files(pages.where("entry = '2'").withColumn("html", F.concat("html", F.lit('<a href="x.pdf">a &amp; b.pdf</a><a href="#">no.pdf</a>'))), addresses.BASE).collect()
    assert {r["name"] for r in few if r["url"].endswith("/x.pdf")} <= {"a & b.pdf"} and not [r for r in few if r["name"] == "no.pdf"]


def test_logs_are_written_a_folder_for_each_task(spark, tmp_path):
    """The driver moves folders of tasks, not a file or folder for each log; logs run on over batches of rows."""
    rows = spark.range(3000).select(F.concat(F.lit("u"), F.col("id") % 300, F.lit(".txt")).alias("log"), "id", F.concat(F.lit("zeile é "), "id").alias("line"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        files.write_logs(rows, f"file://{tmp_path}/logs", "log", "id", "line")
        files.write_logs(rows.where("false"), f"file://{tmp_path}/none", "log", "id", "line")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    folders = list((tmp_path / "logs").iterdir())
    assert 0 < len(folders) <= 8 and not [f for f in folders if f.name.startswith("_")]
    got = {p.name: p.read_text() for p in (tmp_path / "logs").rglob("*.txt")}
    assert got == {f"u{k}.txt": "".join(f"zeile é {n}\n" for n in range(k, 3000, 300)) for k in range(300)}
    assert files.log_tails(spark, f"{tmp_path}/logs", ending=".txt", lines=2).count() == 600
    assert files.log_tails(spark, f"{tmp_path}/none").count() == 0


def test_letters_lose_their_marks_without_python(spark, monkeypatch):
    """Every character by itself and between others, as decomposition has it; Python sees special texts only."""
    plain = lambda t: "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn")
    letters, bare, other = T._plain_letters()
    special = re.compile(other)
    by = str.maketrans(dict(zip(letters, [*bare, *[""] * (len(letters) - len(bare))])))
    assert [c for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)]) if not special.match(c) and c.translate(by) != plain(c)] == []
    texts = ["Übung é", "ạ̇ ệ", "한국어 é", "কো", "\U0001d15e é", "᭄〮", "naïve ÅNGSTRÖM \U0002f800", "plain", "", None, "".join(c for c in letters if c.lower() == c and c.strip())]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    want = [None if t is None else " ".join(plain(t.strip().lower()).split()) for t in texts]
    assert [r["m"] for r in df.select("k", T.match_text(F.col("t")).alias("m")).orderBy("k").collect()] == want

    @F.pandas_udf("string")
    def seen(x: pd.Series) -> pd.Series:
        return x.map(lambda t: None if t is None else "seen")

    monkeypatch.setattr(T, "_without_marks", seen)
    assert [r["m"] for r in df.where("k < 8").select("k", T.match_text(F.col("t")).alias("m")).orderBy("k").collect()] == ["ubung e", "a e", "seen", "seen", "seen", "seen", want[6], "plain"]
