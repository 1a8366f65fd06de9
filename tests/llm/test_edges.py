"""Nulls, repeated rows and a very long text, for every operator."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from linkledger.llm import class_lm, decontaminate, language, mixing, near_duplicates, neighbours, repeats, secrets, sharding, token_files

LONG = " ".join(f"word{k % 977} wörter{k % 31}" for k in range(150_000))


@pytest.fixture(scope="module")
def rows(spark):
    data = [(None, None, None, None), (None, "no id", "en", None), (1, "same row twice here", "en", "s"), (1, "same row twice here", "en", "s"), (1, "same id, other text", None, "t"), (2, LONG, "de", "s"), (2, LONG, "de", "s"), (3, None, "en", "s"), (4, "", "en", "s")]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string").withColumn("vec_id", F.lit("clash"))


def test_repeats(rows):
    got = repeats.find_repeats(rows).collect()
    assert len(got) == 9
    n = len(LONG.encode())
    assert sorted((r["doc_id"], r["n_removed"], r["n_spans"]) for r in got if r["doc_id"] == 2) == [(2, n, 1)] * 2
    assert all(r["n_removed"] == 0 for r in got if r["doc_id"] != 2)


@pytest.mark.parametrize("key", ["all alike", "two kinds"])
def test_repeats_of_texts_with_equal_keys(spark, rows, monkeypatch, key):
    """Texts that share a 64-bit key aren't taken for copies, and keep what they hold."""
    body = " ".join(f"shared{k}" for k in range(60))
    more = spark.createDataFrame([(20, f"{body} left"), (21, f"right {body}"), (22, body), (23, body), (24, "unlike any other " * 2)], "doc_id long, text string")
    docs = rows.select("doc_id", "text").unionByName(more)
    want = sorted(map(tuple, repeats.find_repeats(docs).drop("starts", "ends").collect()), key=str)
    monkeypatch.setattr(repeats, "text_key", lambda text: F.lit(7).cast("long") if key == "all alike" else F.length(text).cast("long") % 2)
    assert sorted(map(tuple, repeats.find_repeats(docs).drop("starts", "ends").collect()), key=str) == want
    assert sum(r[2] > 0 for r in want) == 6


def test_decontamination(spark, rows):
    items = spark.createDataFrame([(None, "same row"), (5, "same row twice"), (6, None)], "item_id long, text string")
    got = decontaminate.find_hits(rows, items, "h").collect()
    assert len(got) == 9 and sorted(r["doc_id"] for r in got if r["h"]["items"]) == [1, 1]
    assert decontaminate.clean_documents(rows, items).count() == 7
    assert decontaminate.clean_documents(rows, items.where("false")).count() == 9


def test_neighbours(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0], "x"), (1, [1.0, 0.0], "x"), (None, [1.0, 1.0], "y"), (2, [0.5, 0.5], None), (3, [0.5, 0.5], None)], "vec_id long, embedding array<float>, score string")
    got = neighbours.nearest(vectors, vectors.where("vec_id = 1"), 5).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(1, 1, 2, 0.5), (1, 2, 3, 0.5)]


def test_language(rows):
    learned = language.learn(rows)
    assert set(learned) == {"en", "de"}
    got = language.identify(rows, learned, "f").select("doc_id", "f.lang").collect()
    assert len(got) == 9 and [r["lang"] for r in got if r["doc_id"] == 2] == ["de", "de"] and {r["lang"] for r in got if r["doc_id"] in (3, 4)} == {"und"}


def test_shards(rows):
    got = sharding.shards(rows, limit=1 << 20)
    assert got.count() == 9 and set(rows.columns) <= set(got.columns)
    assert all(r["shard_bytes"] <= 1 << 20 or r["shard_docs"] == 1 for r in got.collect())


def test_near_duplicates(rows):
    got = near_duplicates.near_duplicates(rows).collect()
    assert len(got) == 9
    assert [r["component_id"] for r in got if r["doc_id"] == 2] == [2, 2]
    assert near_duplicates.one_of_each(rows).count() == 9


def test_secrets(rows):
    got = secrets.scan(rows.withColumn("_base", F.lit("clash")).withColumn("found", F.lit("clash")), "_found")
    assert got.count() == 9 and {"_base", "found"} <= set(got.columns)
    assert secrets.scan(rows.where("false"), "found").collect() == []


def test_empty_tables(rows):
    none = rows.where("false")
    assert near_duplicates.near_duplicates(none).collect() == [] and mixing.mix(none).collect() == [] and sharding.shards(none).collect() == []
    assert decontaminate.find_hits(none, rows.select(F.col("doc_id").alias("item_id"), "text"), "h").collect() == []


def test_mixing(rows):
    got = mixing.mix(rows).collect()
    assert len(got) == 9 and sum(r["taken"] for r in got) == sum(round(t) for t in {r["source"]: r["target"] for r in got}.values())


def test_token_files(spark, rows, tmp_path):
    token_files.write(rows, str(tmp_path / "t"), public_tokenizers.path("byte_bpe_50k.json"))
    got = token_files.read(spark, str(tmp_path / "t")).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, None, 1, 1, 1, 2, 2, 3, 4]
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    assert len({r["ids_crc32"] for r in got if r["doc_id"] == 2}) == 1
    assert len(token_files.read_document(spark, str(tmp_path / "t"), 1)) == 3


def test_scores(rows):
    got = class_lm.score(rows).collect()
    assert len(got) == 9 and all(r["score"] < 0 and r["base_score"] < 0 for r in got)
    assert len({(r["n_tokens"], r["score"]) for r in got if r["doc_id"] == 2}) == 1
