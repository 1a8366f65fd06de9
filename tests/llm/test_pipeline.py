"""The pipeline against plain versions of its stages, and what its parts promise one another."""

from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

import __spark_entry__
from linkledger.llm import mixing

from . import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, SF).cache()
        kept.append((name, before, docs))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    assert [k[0] for k in kept] == ["language", "near_duplicates", "decontamination", "mixing", "sharding"]
    whole = lambda df: sorted(tuple(r) for r in df.select(columns).collect())
    lettered = {r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").where(r"text rlike '\\p{L}'").select("doc_id").collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    clean = brute.pipeline([tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select(columns).collect()], items, lettered)
    assert whole(kept[2][2]) == clean
    wanted = {r["doc_id"]: int(r["taken"] / r["size"] + 0.5) for r in mixing.mix(kept[2][2]).collect() if r["size"]}
    assert Counter(r["doc_id"] for r in kept[3][2].collect()) == Counter({k: v for k, v in wanted.items() if v})
    assert whole(kept[4][2]) == whole(kept[3][2])
    assert whole(corpus_pipeline.run(spark, SF)) == whole(kept[4][2])


def test_stages_keep_names_that_clash(spark):
    docs = spark.createDataFrame([(k, t, "en", "s", 3, "x", 1, 2) for k, t in enumerate([None, "", "one two three four", "one two three four", "a b c d e f g"])], "doc_id long, text string, lang string, source string, n_chars long, _hits string, _copies int, shard int")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert {"_hits", "_copies", "shard"} <= set(docs.columns) and docs.count() >= 1


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.collect() == []


def test_entry_registers_all_thirteen_and_the_pipeline():
    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 14)} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
