"""Crowds of loosely alike texts, and sets whose 64-bit names are the same."""

import random

import pytest
from pyspark.sql import functions as F

from linkledger.llm import near_duplicates

from . import brute


def crowd(n, own, mates=0, seed=3):
    """Texts of one long passage and `own` words of theirs; some with a mate that differs by a few words."""
    rng = random.Random(seed)
    passage, texts = [f"w{k}" for k in range(170)], []
    for k in range(n):
        words = passage + [f"x{rng.random()}" for _ in range(own)]
        texts.append(words)
        if k < mates:
            texts.append(words[:-6] + [f"y{rng.random()}" for _ in range(rng.choice([6, 9, 14]))])
    rng.shuffle(texts)
    return [(k, " ".join(t)) for k, t in enumerate(texts)]


def found(docs, shingle=2):
    return sorted((tuple(r) for r in near_duplicates.near_duplicates(docs, shingle=shingle).collect()), key=str)


@pytest.fixture()
def watched(monkeypatch):
    """The numbers of pairs and of rows left to tiles of each call, were no link known before."""
    seen, plain = [], near_duplicates.deep_candidates

    def counting(known, *of):
        pairs, hot = plain(known.withColumn("root", F.col("node")), *of)
        seen.append((pairs.count(), hot.count()))
        return plain(known, *of)

    monkeypatch.setattr(near_duplicates, "deep_candidates", counting)
    return seen


@pytest.mark.parametrize("own", [20, 30, 44])
def test_wide_crowds_lose_no_link(spark, monkeypatch, watched, own):
    monkeypatch.setattr(near_duplicates, "TILE", 40)
    rows = crowd(160, own, 40)
    want = brute.near(rows, 2)
    for listed in (64, 4):  # with few rows a shingle, more of them are left to tiles
        monkeypatch.setattr(near_duplicates, "LIST", listed)
        assert found(spark.createDataFrame(rows, "doc_id long, text string")) == want
    assert watched or own == 20


def test_pairs_follow_the_rows_of_a_crowd(spark, monkeypatch, watched):
    """Four times the rows of a crowd in which hardly any two are links: four times the pairs, not sixteen."""
    monkeypatch.setattr(near_duplicates, "TILE", 100)
    for n in (1000, 4000):
        rows = crowd(n, 36, n // 10)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
        got = found(docs)
        assert len({r[2] for r in got}) <= n
    (few, none), (many, still) = watched
    assert none == still == 0
    assert 50 < few < 1000 and many < 5 * few


def test_sets_of_one_name_are_told_apart(spark, monkeypatch):
    rows = crowd(60, 44, 20)
    monkeypatch.setattr(near_duplicates, "TILE", 20)
    monkeypatch.setattr(near_duplicates, "named_by", lambda node: F.pmod(node, F.lit(7)))
    rows += [(k + 1000, t) for k, t in rows[:9]] + [(2000, None), (2001, ""), (2002, " ")]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute.near(rows, 2)
