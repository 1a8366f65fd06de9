"""Exact search for the largest inner products by a bit-sliced index.

Each component x of a vector is quantised to floor(SCALE * x). An index row holds up to
some thousand vectors of one length: for each component, its values above the smallest
one as slices, bitmaps of one bit of all rows' values each, and the values themselves.

A query's components are weights. Each weight is a sum of few powers of two with signs,
so the weighted sum of all components is a sum of shifted slices: those of negative
powers are complemented, which only adds a constant. The slices of each power are added
three at a time by bitmap arithmetic: their parity stays, their carry goes to the next
power. The sum is itself a stack of slices. The k-th largest sum is read from the most
significant slice downward, by counting bits.

The lowest bits of wide components are left out of the slices: a row's sum is then off by
a bounded amount. All rows within that bound of the k-th largest sum are boundary rows;
their inner products are computed exactly from the stored values, and decide. So results
are exact for all vectors. Shards' results are merged by score, then vec_id.

Queries are packed into blocks; each block meets each shard of its length. This is a
stated set of queries against all rows, so work grows as queries times rows.

Defined cases: vectors that are null or hold null or non-finite components take no part;
zero vectors do, and empty ones meet only empty ones, with score 0; vectors meet only
those of their own length; equal scores go by the smaller vec_id; rows repeated as a
whole are candidates each and one query; a query finds no row of its own id; rows without
id take no part; fewer candidates than k give fewer rows; an empty table gives an empty
result; columns of other names are not read. Quantised components beyond +-2**62 count as
that, and scores beyond a long as its limit. A shard, or a block of queries, is the
largest thing in a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _spark as S

SCALE = 1024
#: Vectors of a shard at most, bytes of their values, about, and queries of a block.
SHARD, BYTES, BLOCK = 16384, 8 << 20, 256
#: Slices of a component of usual width; the bits below are left to the exact comparison.
SLICES = 7
U64 = np.uint64
ONES = U64(0xFFFFFFFFFFFFFFFF)
LIMIT = 1 << 62
INDEX = "dims int, shard int, size int, cut int, low binary, widths binary, slices binary, values binary, ids array<long>"


def finite(vector: Column) -> Column:
    """Whether a vector takes part."""
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """array<long> of floor(scale * x), x as a double."""
    return F.transform(vector, lambda x: F.floor(F.greatest(F.least(scale * x.cast("double"), F.lit(float(LIMIT))), F.lit(-float(LIMIT)))))


def powers(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers for each weight, without a common bit, of which it is the difference; of all such pairs, they have the fewest bits."""
    size = np.abs(weights).astype(U64)
    triple = size * U64(3)
    more, less = (triple & ~size) >> U64(1), (size & ~triple) >> U64(1)
    return np.where(weights < 0, less, more), np.where(weights < 0, more, less)


def sliced(values: np.ndarray, cut: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(least value, number of slices) of each column of values, and all slices, a row of bits each, the lowest first."""
    low = values.min(axis=0)
    above = (values - low).astype(U64) >> U64(cut)
    widths = np.array([int(x).bit_length() for x in above.max(axis=0)], np.int64)
    words = -(-len(values) // 64)
    out = np.zeros((int(widths.sum()), words * 8), np.uint8)
    for row, (d, i) in enumerate((d, i) for d, n in enumerate(widths) for i in range(n)):
        bits = np.packbits(((above[:, d] >> U64(i)) & U64(1)).astype(np.uint8), bitorder="little")
        out[row, : len(bits)] = bits
    return low, widths, out.view(U64)


def added(columns: list[list[np.ndarray]]) -> list[np.ndarray]:
    """The sum of bitmaps, columns[j] with weight 2 ** j, as its slices; columns are used up."""
    out, j = [], 0
    while j < len(columns):
        held = np.concatenate(columns[j]) if columns[j] else None
        columns[j] = []
        carried = []
        while held is not None and len(held) > 1:
            if len(held) == 2:
                carried.append(held[:1] & held[1:])
                held = held[:1] ^ held[1:]
            else:
                k = len(held) // 3
                a, b, c = held[:k], held[k : 2 * k], held[2 * k : 3 * k]
                half = a ^ b
                carried.append((a & b) | (half & c))
                held = np.concatenate([half ^ c, held[3 * k :]])
        out.append(None if held is None else held[0])
        if carried:
            if j + 1 == len(columns):
                columns.append([])
            columns[j + 1] += carried
        j += 1
    return out


def kth_largest(sums: list[np.ndarray | None], rows: np.ndarray, k: int) -> int:
    """The k-th largest of the rows' sums, from the most significant slice downward; rows holds k bits at least."""
    equal, above, value = rows.copy(), 0, 0
    for j in range(len(sums) - 1, -1, -1):
        if sums[j] is None:
            continue
        ones = equal & sums[j]
        n = int(np.bitwise_count(ones).sum())
        if above + n >= k:
            equal, value = ones, value | 1 << j
        else:
            equal, above = equal & ~sums[j], above + n
    return value


def at_least(sums: list[np.ndarray | None], rows: np.ndarray, value: int) -> np.ndarray:
    """The rows whose sums are `value` or more; it has no bit above the sums' slices."""
    if value <= 0:
        return rows
    equal, more = rows.copy(), np.zeros_like(rows)
    for j in range(len(sums) - 1, -1, -1):
        bits = sums[j] if sums[j] is not None else np.zeros_like(rows)
        if value >> j & 1:
            equal &= bits
        else:
            more |= equal & bits
            equal &= ~bits
    return more | equal


class Shard:
    """A shard of the index, read from its row."""

    def __init__(self, size: int, dims: int, cut: int, low: bytes, widths: bytes, slices: bytes, values: bytes, ids: np.ndarray) -> None:
        self.cut, self.ids = cut, ids
        self.values = np.frombuffer(values, np.int64).reshape(size, dims)
        widths = np.frombuffer(widths, np.int64)
        words = -(-size // 64)
        self.slices = np.frombuffer(slices, U64).reshape(int(widths.sum()), words)
        self.of = np.repeat(np.arange(dims), widths)
        self.bit = np.arange(len(self.of)) - np.repeat(np.cumsum(widths) - widths, widths)
        self.largest = max((abs(int(x)) for x in (self.values.min(initial=0), self.values.max(initial=0))), default=0)
        self.rows = np.full(words, ONES)
        if size % 64:
            self.rows[-1] = U64((1 << size % 64) - 1)

    def sums(self, query: np.ndarray) -> list[np.ndarray | None]:
        """The slices of what all rows' inner products are by the sliced bits, but for a constant and the cut."""
        more, less = powers(query)
        columns: list[list[np.ndarray]] = []
        for sign, weights in ((0, more), (1, less)):
            for b in range(int(weights.max(initial=0)).bit_length()):
                rows = np.flatnonzero((weights[self.of] >> U64(b)) & U64(1))
                for at in np.unique(self.bit[rows]):
                    while len(columns) <= b + at:
                        columns.append([])
                    taken = self.slices[rows[self.bit[rows] == at]]
                    columns[b + at].append(~taken if sign else taken)
        return added(columns)

    def best(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(vec_id, score) of the query's k best rows, none of its own id."""
        rows = self.rows.copy()
        a, b = np.searchsorted(self.ids, own), np.searchsorted(self.ids, own, side="right")
        for at in range(a, b):
            rows[at >> 6] &= ~(U64(1) << U64(at & 63))
        if int(np.bitwise_count(rows).sum()) > k:
            sums = self.sums(query)
            # what the bits below the cut can add or take away
            off = sum(abs(int(x)) for x in query) * ((1 << self.cut) - 1)
            rows = at_least(sums, rows, kth_largest(sums, rows, k) - (off >> self.cut))
        near = np.flatnonzero(np.unpackbits(rows.view(np.uint8), bitorder="little"))
        if self.largest * sum(abs(int(x)) for x in query) < 1 << 63:
            score = self.values[near] @ query
        else:
            exact = self.values[near].astype(object) @ query.astype(object) if len(query) else [0] * len(near)
            score = np.array([max(-(1 << 63), min((1 << 63) - 1, int(x))) for x in exact], np.int64)
        order = np.lexsort((self.ids[near], ~score))[:k]  # ~ turns the order of longs about
        return self.ids[near][order], score[order]


def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("vec_id")
    dims = int(key[0])
    values = np.array(rows["vector"].tolist(), np.int64).reshape(len(rows), dims)
    usual = sorted(int(b - a).bit_length() for a, b in zip(values.min(axis=0).tolist(), values.max(axis=0).tolist(), strict=True))
    cut = max(0, usual[dims // 2] - SLICES) if dims else 0
    low, widths, slices = sliced(values, cut)
    return pd.DataFrame([{"dims": dims, "shard": int(key[1]), "size": len(rows), "cut": cut, "low": low.tobytes(), "widths": widths.tobytes(), "slices": slices.tobytes(), "values": values.tobytes(), "ids": rows["vec_id"].to_numpy()}])


def index(vectors: DataFrame, shard: int = SHARD) -> tuple[DataFrame, dict[int, int]]:
    """A row for each shard of vectors (vec_id, vector), as INDEX has it, and how many shards each length of vectors has."""
    sized = vectors.withColumn("dims", F.size("vector"))
    n = {r["dims"]: r["n"] for r in sized.groupBy("dims").agg(F.count("*").alias("n")).collect()}  # a row for each length of vectors
    counts = {d: -(-m // max(64, min(shard, BYTES // (8 * max(1, d))))) for d, m in n.items()}
    if not n:
        return vectors.sparkSession.createDataFrame([], INDEX), counts
    dealt = sized.withColumn("shard", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), shards_of(counts)).cast("int"))
    return S.cut(dealt.groupBy("dims", "shard").applyInPandas(build, INDEX)), counts


def shards_of(counts: dict[int, int]) -> Column:
    """The number of shards of the row's `dims`."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in counts.items() for x in pair)), F.col("dims"))


def blocks(queries: DataFrame) -> DataFrame:
    """Queries (query_id, vector) packed: dims, query_ids and their vectors one after the other."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}

        def packed(dims: int) -> pa.RecordBatch:
            ids, rows = held.pop(dims)
            return pa.record_batch([pa.array([dims], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([np.array(rows, np.int64).tobytes()], pa.binary())], ["dims", "query_ids", "queries"])

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, rows = held.setdefault(len(v), ([], []))
                ids.append(i)
                rows.append(v)
                if len(ids) == BLOCK:
                    yield packed(len(v))
        for dims in list(held):
            yield packed(dims)

    return queries.repartition(max(1, round(queries.count() / BLOCK))).mapInArrow(pack, "dims int, query_ids array<long>, queries binary")


def top(vectors: DataFrame, queries: DataFrame, k: int, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE, shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id and score: each query's k rows with the largest inner products of quantised vectors, exactly."""
    rows = lambda df, name: df.where(finite(F.col(vector)) & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias(name), quantised(F.col(vector), scale).alias("vector"))
    held, counts = index(rows(vectors, "vec_id"), shard)
    asked = S.cut(blocks(rows(queries, "query_id").dropDuplicates())).where(F.col("dims").isin(list(counts)))
    every = F.sequence(F.lit(0), shards_of(counts) - 1) if counts else F.array().cast("array<int>")
    pairs = asked.withColumn("shard", F.explode(every)).join(held, ["dims", "shard"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = {name: batch.column(c)[i] for c, name in enumerate(batch.schema.names)}
                dims = row["dims"].as_py()
                own = Shard(row["size"].as_py(), dims, row["cut"].as_py(), *(row[c].as_buffer() for c in ("low", "widths", "slices", "values")), row["ids"].values.to_numpy(zero_copy_only=False))
                ids = row["query_ids"].values.to_numpy(zero_copy_only=False)
                x = np.frombuffer(row["queries"].as_buffer(), np.int64).reshape(len(ids), dims)
                found = [own.best(int(j), v, k) for j, v in zip(ids, x, strict=True)]
                n = [len(f[0]) for f in found]
                asked_by = np.array([int.from_bytes(hashlib.blake2b(v.tobytes(), digest_size=8).digest(), "little", signed=True) for v in x], np.int64)
                yield pa.record_batch([pa.array(np.repeat(ids, n)), pa.array(np.repeat(asked_by, n)), pa.array(np.concatenate([f[0] for f in found])), pa.array(np.concatenate([f[1] for f in found]))], ["query_id", "asked", "vec_id", "score"])

    found = pairs.mapInArrow(search, "query_id long, asked long, vec_id long, score long")
    order = Window.partitionBy("query_id", "asked").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op12_bit_sliced_top(spark, sf_dir: str) -> DataFrame:
    """The 10 largest integer inner products of every hundredth vector."""
    vectors = S.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top(vectors, vectors.where(F.col("vec_id") % 100 == 0), 10)


ORACLE = f"""
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS e FROM embeddings
               WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
    pairs AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::BIGINT AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0)
    SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM pairs
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10"""
ORACLES = {"op12_bit_sliced_top": ORACLE}
