"""The filter audit against one document after the other in every order."""

import os
import random
import re
from collections import Counter
from itertools import permutations

import duckdb
from pyspark.sql import functions as F

from linkledger.llm import filter_audit
from linkledger.llm.queries import ORACLES, QUERIES

from ..test_queries import cells

SF = "/root/testdata/sf0.001"


def plain(docs, labels):
    """Every count, by applying each filter to each document that is still there."""
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    fails = []
    for i, text, _ in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        copy = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)
        fails.append({f for f, yes in zip("ABCDE", (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), re.search(r"[#$%&*|]", t), copy), strict=True) if yes})
    out = {}
    for part in {s or "" for *_, s in docs}:
        own = [(i, fails[k]) for k, (i, _, s) in enumerate(docs) if (s or "") == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left, gone = own, []
            for step, f in enumerate(order, 1):
                hit = [(i, x) for i, x in left if f in x]
                shapley[f] += len(hit)
                out[part, "".join(order), step] = (len(left) - len(hit), len(hit), sum(f in x for _, x in gone), sum(x == {f} for _, x in own), sum(i in good for i, _ in hit), sum(i in toxic for i, _ in hit))
                gone = gone + hit
                left = [(i, x) for i, x in left if f not in x]
        for part_, order, step in list(out):
            if part_ == part:
                out[part, order, step] += (shapley[order[step - 1]],)
    return out


COLUMNS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def rows_of(result):
    got = result.collect()
    assert len({(r["part"], r["filter_order"], r["step"]) for r in got}) == len(got)
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in COLUMNS) for r in got}


def test_table_of_steps():
    table = filter_audit.steps_table()
    assert table.shape == (32, 120) and (table[0] == 5).all() and (table[31] == 0).all()
    order = filter_audit.ORDERS.index("CABED")
    assert [int(x) for x in table[[1, 2, 4, 8, 16, 1 | 4, 8 | 16], order]] == [1, 2, 0, 4, 3, 0, 3]


def odd_docs():
    random.seed(8)
    long = [" ".join(random.choice(["alpha", "Beta", "gamma"]) + str(random.randrange(m)) for _ in range(n)) for n, m in ((199, 500), (200, 500), (400, 20), (250, 4))]
    texts = [None, "", " \t", "a", "a", "É é", "A", "x" * 49 + "A", "x" * 48 + "AA", "a|b", "A a", "word " * 250, *long, long[1] + " #", *long]
    docs = [(k, t, random.choice(["s", "t", None, ""])) for k, t in enumerate(texts)]
    return docs + [(None, "a", "s"), (None, "only here", "u"), (3, "a", "s"), (3, "a", "s"), (12, texts[12], "s"), (1, "a", "t")]


def test_odd_rows(spark):
    docs, labels = odd_docs(), [(0, 1, 0), (3, 1, 1), (3, 0, None), (4, 0, 1), (None, 1, 1), (15, 1, 0), (99, 1, 1), (16, None, 1), (13, 1, 1)]
    table = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("mask", F.lit("clash")).withColumn("_h", F.lit(0)).repartition(5)
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))
    assert rows_of(filter_audit.audit(filter_audit.masks(table, said))) == plain(docs, labels)
    assert filter_audit.audit(filter_audit.masks(table.where("false"), said)).collect() == []
    assert len(rows_of(filter_audit.audit(filter_audit.masks(table, said.where("false"))))) == 600 * len({s or "" for *_, s in docs})


def test_arrays_are_given_up_in_time(spark, monkeypatch):
    rows = spark.range(0, 60, 1, 3).select((F.col("id") % 7).cast("string").alias("part"), (F.col("id") % 32).cast("int").alias("mask"), (F.col("id") % 2 == 0).alias("good"), F.lit(False).alias("toxic"))
    whole = rows_of(filter_audit.audit(rows))
    monkeypatch.setattr(filter_audit, "HELD", 2)
    assert rows_of(filter_audit.audit(rows)) == whole


def test_query_against_sql_and_the_plain_version(spark):
    con = duckdb.connect()
    for name in ("documents", "labels", "embeddings"):
        con.execute(f"create view {name} as select * from '{os.path.join(SF, name)}.parquet'")
    for query in ("op13_filter_audit", "op12_bit_sliced_top"):
        got, want = QUERIES[query](spark, SF).toPandas(), con.execute(ORACLES[query]).df()
        assert cells(got.astype(str)) == cells(want.astype(str)) and len(got)
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert rows_of(filter_audit.op13_filter_audit(spark, SF)) == plain(docs, labels)
