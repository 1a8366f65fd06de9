"""The bit-sliced index against all inner products."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkledger.llm import bit_slices


def plain(vectors, queries, k, scale=1024):
    """(query_id, rank, vec_id, score) with Python's integers."""
    fine = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    clamp = lambda x: max(-(2.0**62), min(2.0**62, x))
    whole = lambda rows: [(i, [math.floor(clamp(scale * x)) for x in v]) for i, v in rows if i is not None and fine(v)]
    candidates, out = whole(vectors), []
    for i, q in {(i, tuple(q)) for i, q in whole(queries)}:
        scores = [(max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(q, v, strict=True)))), j) for j, v in candidates if j != i and len(v) == len(q)]
        out += [(i, n + 1, j, s) for n, (s, j) in enumerate(sorted(scores, key=lambda x: (-x[0], x[1]))[:k])]
    return sorted(out)


def agree(spark, rows, k=10, **how):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("clash"))
    asked = [r for r in rows if r[0] is not None and r[0] % 7 == 0]
    got = bit_slices.top(table, table.where("vec_id % 7 = 0"), k, **how).collect()
    assert sorted(tuple(r) for r in got) == plain(rows, asked, k)


def test_a_weight_is_a_sum_of_few_powers():
    weights = np.array([0, 1, -1, 3, 7, -7, 11, 1023, -1024, 693, (1 << 62) - 1, -(1 << 61)], np.int64)
    more, less = bit_slices.powers(weights)
    assert [int(a) - int(b) for a, b in zip(more, less, strict=True)] == weights.tolist()
    assert [int(a).bit_count() + int(b).bit_count() for a, b in zip(more, less, strict=True)][:8] == [0, 1, 1, 2, 2, 2, 3, 2]


@pytest.mark.parametrize("kind", ["usual", "one long", "mixed norms", "ties", "small"])
def test_against_all_products(spark, kind):
    random = np.random.default_rng(3)
    x = random.normal(size=(900, 12)) / 4
    if kind == "one long":
        x[5] *= 1e6
    elif kind == "mixed norms":
        x *= 10.0 ** random.integers(-4, 5, size=(900, 1))
    elif kind == "ties":
        x = np.round(x)
    elif kind == "small":
        x /= 500
    agree(spark, [(i, v) for i, v in enumerate(x.tolist())], shard=200)


def test_the_index_leaves_few_rows_to_the_exact_comparison():
    random = np.random.default_rng(4)
    values = np.floor(1024 * random.normal(size=(4000, 64)) / 8).astype(np.int64)
    import pandas as pd

    row = bit_slices.build((64, 0), pd.DataFrame({"vec_id": np.arange(4000), "vector": values.tolist()})).iloc[0]
    shard = bit_slices.Shard(row["size"], 64, row["cut"], row["low"], row["widths"], row["slices"], row["values"], row["ids"])
    assert row["cut"] >= 2 and len(shard.slices) <= 64 * (bit_slices.SLICES + 2)
    query = values[17]
    sums = shard.sums(query)
    # the sums are those of the upper bits
    more, less = bit_slices.powers(query)
    widths = np.frombuffer(row["widths"], np.int64)
    upper = (values - values.min(axis=0)) >> row["cut"]
    want = upper @ more.astype(np.int64) + ((1 << widths) - 1 - upper) @ less.astype(np.int64)
    bits = [np.unpackbits(s.view(np.uint8), bitorder="little")[:4000].astype(np.int64) if s is not None else 0 for s in sums]
    assert (sum(b << j for j, b in enumerate(bits)) == want).all()
    assert bit_slices.kth_largest(sums, shard.rows, 10) == np.sort(want)[-10]
    off = int(np.abs(query).sum()) * ((1 << row["cut"]) - 1)
    near = bit_slices.at_least(sums, shard.rows, int(np.sort(want)[-10]) - (off >> row["cut"]))
    assert 10 <= int(np.bitwise_count(near).sum()) < 400


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [3.0, -1.0]), (1, None), (2, [None, 1.0]), (3, [nan, 1.0]), (4, [inf, 0.0]), (None, [9.0, 9.0]), (5, [0.0, 0.0]), (6, [2.0, 2.0]), (6, [2.0, 2.0]), (7, [1.0]), (8, [5.0]), (9, []), (14, []), (21, [1e300, -1e300]), (22, [1e15, 1e15]), (23, [-1e308, 1.0]), (28, [0.0001, -0.0001])]
    agree(spark, rows, k=4)
    agree(spark, rows, k=40, shard=64)
    table = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert bit_slices.top(table, table, 3).collect() == []


def test_more_dimensions_than_a_shard_holds_rows_for(spark):
    random = np.random.default_rng(5)
    agree(spark, [(i, v) for i, v in enumerate(random.normal(size=(150, 700)).tolist())], k=3)
