"""Approximate nearest neighbours by inner product: one navigable small-world graph per shard.

Vectors are dealt into bands of norms, a factor of two each, and a band by a hash into
shards of about SHARD rows. A shard is one row: its distinct vectors, the ids that share
each, and the flat neighbour arrays of a hierarchical graph, from which the inner product is
searched after one more component has made all vectors equally long. In a band that
component is of the others' size, so no vector's length hides the differences of others, and
vectors are scaled to a length of one for the search, so no component is too large for it.
Rows of bands with fewer than an eighth of SHARD rows are in shards without graph, which
are searched exactly. Nodes rise to higher levels by chance; on each level a node keeps its
nearest neighbours that are nearer to it than to one another, and what links back to it, up
to a fixed number. (Neighbour lists are found exactly, in blocks, inside the bounded shard,
rather than by one insertion after the other.)

Queries are packed into blocks; each block meets each shard of its dimension, descends the
levels and widens a beam of BEAM nodes on the lowest. The shards' results are merged by
score. Work grows as queries times shards. A choice of shards by coarse centroids was
measured and left out: of vectors without clusters, a quarter of the rows, those nearest by
centroid, hold just 0.6 of the 20 nearest.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components
take no part; vectors meet only those of their own length; norms may differ by any factor;
products beyond a double are infinite, and sums of opposite infinities rank last; equal
vectors are one node, so a crowd of copies is found by its smallest ids; equal scores go by
the smaller id, whichever shards they are in; a query finds no row of its own id; rows
repeated as a whole are one query; fewer candidates than k give fewer rows; an empty table
gives an empty result; columns of other names, clashing ones too, are not read. A shard or
a block of queries is the largest thing in a task.
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

from . import _bytes as B
from . import _spark as S

#: Rows of a shard, about, and queries of a block.
SHARD, BLOCK = 16384, 512
#: Links of a node that are chosen, links at most, candidates for them, one in LEVEL rises a level.
LINKS, MOST, CANDIDATES, LEVEL = 24, 48, 56, 16
BEAM = 224
#: Bands of fewer rows than a shard by this factor get no graph.
SPARSE = 8
INDEX = "dims int, shard int, nodes int, vectors binary, ids array<long>, first array<int>, levels array<struct<nodes:binary,links:binary>>"


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def links_of(vectors: np.ndarray) -> np.ndarray:
    """Each row's neighbours among equally long vectors, -1 where there are fewer."""
    n = len(vectors)
    k = min(CANDIDATES, n - 1)
    if k < 1:
        return np.full((n, MOST), -1, np.int32)
    near, close = np.empty((n, k), np.int32), np.empty((n, k), np.float32)
    for a in range(0, n, 512):
        sims = vectors[a : a + 512] @ vectors.T
        sims[np.arange(len(sims)), np.arange(a, a + len(sims))] = -np.inf
        top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        own = np.take_along_axis(sims, top, 1)
        order = np.argsort(-own, axis=1, kind="stable")
        near[a : a + 512], close[a : a + 512] = np.take_along_axis(top, order, 1), np.take_along_axis(own, order, 1)
    chosen = np.zeros((n, k), bool)
    for a in range(0, n, 512):
        x = vectors[near[a : a + 512]]
        between = np.einsum("nkd,njd->nkj", x, x, optimize=True)
        kept = chosen[a : a + 512]
        for c in range(k):
            beaten = (kept[:, :c] & (between[:, c, :c] > close[a : a + 512, c, None])).any(1) if c else np.zeros(len(x), bool)
            kept[:, c] = ~beaten & (kept.sum(1) < LINKS)
        # what is left of the links goes to the nearest that were passed over
        room = LINKS - kept.sum(1)
        passed = ~kept
        kept |= passed & (np.cumsum(passed, 1) <= room[:, None])
    u, c = np.nonzero(chosen)
    v, s = near[u, c].astype(np.int64), close[u, c]
    pairs = np.concatenate([u * n + v, v * n + u])
    own = np.concatenate([np.ones(len(u), bool), np.zeros(len(u), bool)])
    sims = np.concatenate([s, s])
    pairs, at = np.unique(pairs, return_index=True)  # the first of equal pairs is the chosen one
    own, sims = own[at], sims[at]
    u, v = pairs // n, pairs % n
    order = np.lexsort((-sims, ~own, u))
    u, v = u[order], v[order]
    rank = np.arange(len(u)) - np.searchsorted(u, u)
    out = np.full((n, MOST), -1, np.int32)
    keep = rank < MOST
    out[u[keep], rank[keep]] = v[keep]
    return out


def band(vector: Column) -> Column:
    """log2 of a vector's norm, to the nearest whole number; components are scaled first, so that no square is too large or too small."""
    most = F.array_max(F.transform(vector, lambda x: F.abs(x)))
    squares = F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + (x / most) * (x / most))
    return F.floor(F.log2(most) + 0.5 * F.log2(squares) + 0.5).cast("int")


def of_length_one(vectors: np.ndarray) -> np.ndarray:
    """Each vector, none of them zero, scaled to a length of one."""
    x = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def at_most_one(vectors: np.ndarray) -> np.ndarray:
    """All vectors, none of them zero, scaled alike, the longest one to a length of one."""
    x = vectors / np.abs(vectors).max()
    return x / np.sqrt((x * x).sum(axis=1).max())


def long_as_all(vectors: np.ndarray) -> np.ndarray:
    """Vectors of a length of one at most, with one more component that makes it one; inner products with (query, 0) stay."""
    return np.hstack([vectors, np.sqrt(np.maximum(1 - (vectors * vectors).sum(axis=1), 0))[:, None]]).astype(np.float32)


def build(k: int):
    def of(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id")
        vectors = np.array(rows["vector"].tolist(), np.float64)
        _, first, of, n = np.unique(vectors, axis=0, return_index=True, return_inverse=True, return_counts=True)
        of = of.ravel()
        order = np.argsort(of, kind="stable")  # each node's ids, ascending
        rank = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        ids = rows["vec_id"].to_numpy()[order][rank <= k]  # one more than asked for: the query's own may be among them
        held = np.minimum(n, k + 1)
        nodes = vectors[first]
        row = {"dims": int(key[0]), "shard": int(key[1]), "nodes": len(nodes), "vectors": nodes.tobytes(), "ids": ids, "first": (np.cumsum(held) - held).astype(np.int32), "levels": []}
        if not key[2]:
            return pd.DataFrame([row])
        x = long_as_all(at_most_one(nodes))
        chance = B.mix(np.arange(len(nodes), dtype=B.U64) + B.U64(77)).astype(np.float64) / 2.0**64
        level = np.floor(-np.log(np.maximum(chance, 1e-18)) / np.log(LEVEL)).astype(int)
        for at in range(level.max() + 1):
            own = np.flatnonzero(level >= at).astype(np.int32)
            links = links_of(x[own])
            row["levels"].append({"nodes": own.tobytes(), "links": np.where(links >= 0, own[links], -1).astype(np.int32).tobytes()})
        return pd.DataFrame([row])

    return of


class Shard:
    """A shard's graph, read from its row."""

    def __init__(self, nodes: int, dims: int, vectors: bytes, ids: np.ndarray, first: np.ndarray, levels: list[tuple[bytes, bytes]]) -> None:
        self.vectors = np.frombuffer(vectors, np.float64).reshape(nodes, dims)
        self.near = at_most_one(self.vectors).astype(np.float32)
        self.ids, self.first = ids, np.append(first, len(ids))
        self.links = []
        for own, links in levels:
            full = np.full((nodes, MOST), -1, np.int32)
            full[np.frombuffer(own, np.int32)] = np.frombuffer(links, np.int32).reshape(-1, MOST)
            self.links.append(full)
        self.entry = int(np.frombuffer(levels[-1][0], np.int32)[0]) if levels else 0

    def all_nodes(self, queries: np.ndarray, width: int) -> np.ndarray:
        """The best nodes of all, of a shard without graph; which of some thousands they are is judged in doubles."""
        n = len(self.vectors)
        if width >= n:
            return np.tile(np.arange(n, dtype=np.int32), (len(queries), 1))
        with np.errstate(all="ignore"):
            return np.argpartition(-(queries @ self.vectors.T), width - 1, axis=1)[:, :width].astype(np.int32)

    def beam(self, queries: np.ndarray, width: int) -> np.ndarray:
        """The nodes found for each query, -1 where there are fewer."""
        q, n = len(queries), len(self.near)
        everyone = np.arange(q)
        at = np.full(q, self.entry)
        sims = queries @ self.near[self.entry]
        for links in self.links[:0:-1]:
            moving = everyone
            while len(moving):
                next_ = links[at[moving]]
                s = np.einsum("qd,qmd->qm", queries[moving], self.near[next_])
                s[next_ < 0] = -np.inf
                best = s.argmax(1)
                value = s[np.arange(len(moving)), best]
                better = value > sims[moving]
                moving, best, value, next_ = moving[better], best[better], value[better], next_[better]
                at[moving], sims[moving] = next_[np.arange(len(moving)), best], value
        width = min(width, n)
        found = np.full((q, width), -1, np.int32)
        score = np.full((q, width), -np.inf, np.float32)
        open_ = np.zeros((q, width), bool)
        found[:, 0], score[:, 0], open_[:, 0] = at, sims, True
        seen = np.zeros((q, n + 1), bool)
        seen[:, n] = True
        seen[everyone, at] = True
        links = self.links[0]
        active = everyone
        while len(active):
            # the best nodes that were not yet left, four a round
            waiting = np.where(open_[active], score[active], -np.inf)
            best = np.argpartition(-waiting, min(3, width - 1), axis=1)[:, :4]
            good = np.take_along_axis(waiting, best, 1) > -np.inf
            still = good.any(1)
            active, best, good = active[still], best[still], good[still]
            if not len(active):
                break
            rows = active[:, None]
            left = np.where(good, found[rows, best], n)
            open_[rows, best] &= ~good
            next_ = np.where((left < n)[:, :, None], links[np.minimum(left, n - 1)], -1).reshape(len(active), -1)
            next_ = np.sort(np.where(next_ < 0, n, next_), axis=1)
            next_[:, 1:][next_[:, 1:] == next_[:, :-1]] = n
            next_[seen[rows, next_]] = n
            seen[rows, next_] = True
            s = np.full(next_.shape, -np.inf, np.float32)
            r, c = np.nonzero(next_ < n)
            s[r, c] = np.einsum("nd,nd->n", queries[active[r]], self.near[next_[r, c]])
            all_s = np.concatenate([score[active], s], 1)
            top = np.argpartition(-all_s, width - 1, axis=1)[:, :width]
            score[active] = np.take_along_axis(all_s, top, 1)
            found[active] = np.take_along_axis(np.concatenate([found[active], np.where(next_ < n, next_, -1)], 1), top, 1)
            open_[active] = np.take_along_axis(np.concatenate([open_[active], next_ < n], 1), top, 1)
        return found

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of the query, vec_id, score) of each query's k best, its own id left out."""
        width = max(beam, k + 1)
        found = self.beam(of_length_one(queries).astype(np.float32), width) if self.links else self.all_nodes(queries, width)
        r, c = np.nonzero(found >= 0)
        node = found[r, c]
        with np.errstate(all="ignore"):
            score = np.einsum("nd,nd->n", queries[r], self.vectors[node])
        order = np.lexsort((-score, r))
        r, node, score = r[order], node[order], score[order]
        keep = np.arange(len(r)) - np.searchsorted(r, r) <= k
        r, node, score = r[keep], node[keep], score[keep]
        n = (self.first[1:] - self.first[:-1])[node]
        total = np.cumsum(n)
        member = np.arange(total[-1] if len(total) else 0) + np.repeat(self.first[node] - (total - n), n)
        r, score, vec = np.repeat(r, n), np.repeat(score, n), self.ids[member]
        order = np.lexsort((vec, -score, r))
        order = order[vec[order] != ids[r[order]]]
        r, score, vec = r[order], score[order], vec[order]
        keep = np.arange(len(r)) - np.searchsorted(r, r) < k
        return r[keep], vec[keep], score[keep]


def index(vectors: DataFrame, k: int, shard: int = SHARD) -> tuple[DataFrame, dict[int, int]]:
    """A row for each shard of vectors (vec_id, vector), as INDEX has it, and how many shards each length of vectors has."""
    sized = vectors.withColumn("dims", F.size("vector")).withColumn("band", band(F.col("vector")))
    n = {(r["dims"], r["band"]): r["n"] for r in sized.groupBy("dims", "band").agg(F.count("*").alias("n")).collect()}  # a row for each length of vectors and band, of which doubles have some 2100
    counts: dict[int, int] = {}
    if not n:
        return vectors.sparkSession.createDataFrame([], INDEX), counts
    # the shards of each band with a graph, then those of the rest, numbered on for each length
    of_band: dict[str, tuple[int, int]] = {}
    for (d, b), m in sorted(n.items()):
        if m * SPARSE >= shard:
            of_band[f"{d}:{b}"] = (counts.get(d, 0), max(1, round(m / shard)))
            counts[d] = sum(of_band[f"{d}:{b}"])
    rest: dict[int, int] = {}
    for (d, b), m in n.items():
        if f"{d}:{b}" not in of_band:
            rest[d] = rest.get(d, 0) + m
    of_rest = {d: (counts.get(d, 0), -(-m // shard)) for d, m in rest.items()}
    counts |= {d: sum(x) for d, x in of_rest.items()}
    place = lambda of: F.create_map(*(F.lit(x) if i % 2 == 0 else F.struct(F.lit(x[0]).alias("from"), F.lit(x[1]).alias("n")) for pair in of.items() for i, x in enumerate(pair)))
    dense = F.try_element_at(place(of_band), F.concat_ws(":", F.col("dims").cast("string"), F.col("band").cast("string"))) if of_band else F.lit(None).cast("struct<from:int,n:int>")
    sparse = F.try_element_at(place(of_rest), F.col("dims")) if of_rest else F.lit(None).cast("struct<from:int,n:int>")
    dealt = sized.withColumn("_dense", dense).withColumn("graph", F.col("_dense").isNotNull()).withColumn("_at", F.coalesce("_dense", sparse))
    dealt = dealt.withColumn("shard", F.col("_at.from") + F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.col("_at.n")).cast("int")).select("dims", "shard", "graph", "vec_id", "vector")
    return S.cut(dealt.groupBy("dims", "shard", "graph").applyInPandas(build(k), INDEX)), counts


def shards_of(counts: dict[int, int]) -> Column:
    """The number of shards of the row's `dims`."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in counts.items() for x in pair)), F.col("dims"))


def blocks(queries: DataFrame) -> DataFrame:
    """Queries (query_id, vector) packed: dims, query_ids and their vectors one after the other."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}

        def packed(dims: int) -> pa.RecordBatch:
            ids, rows = held.pop(dims)
            return pa.record_batch([pa.array([dims], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([np.array(rows, np.float64).tobytes()], pa.binary())], ["dims", "query_ids", "queries"])

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, rows = held.setdefault(len(v), ([], []))
                ids.append(i)
                rows.append(v)
                if len(ids) == BLOCK:
                    yield packed(len(v))
        for dims in list(held):
            yield packed(dims)

    n = max(1, round(queries.count() / BLOCK))
    return queries.repartition(n).mapInArrow(pack, "dims int, query_ids array<long>, queries binary")


def nearest(vectors: DataFrame, queries: DataFrame, k: int, vec_id: str = "vec_id", vector: str = "embedding", shard: int = SHARD, beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id and score: each query's k nearest rows found."""
    rows = lambda df, name: df.where(usable(F.col(vector))).select(F.col(vec_id).cast("long").alias(name), F.col(vector).cast("array<double>").alias("vector")).where(F.col(name).isNotNull())
    graph, counts = index(rows(vectors, "vec_id"), k, shard)
    asked = S.cut(blocks(rows(queries, "query_id").dropDuplicates())).where(F.col("dims").isin(list(counts)))
    every = F.sequence(F.lit(0), shards_of(counts) - 1) if counts else F.array().cast("array<int>")
    pairs = asked.withColumn("shard", F.explode(every)).join(graph, ["dims", "shard"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = {name: batch.column(c)[i] for c, name in enumerate(batch.schema.names)}
                levels = [(level["nodes"], level["links"]) for level in row["levels"].as_py()]
                dims = row["dims"].as_py()
                own = Shard(row["nodes"].as_py(), dims, row["vectors"].as_buffer(), row["ids"].values.to_numpy(zero_copy_only=False), row["first"].values.to_numpy(zero_copy_only=False), levels)
                ids = row["query_ids"].values.to_numpy(zero_copy_only=False)
                x = np.frombuffer(row["queries"].as_buffer(), np.float64).reshape(-1, dims)
                r, vec, score = own.search(ids, x, k, beam)
                asked_by = np.array([int.from_bytes(hashlib.blake2b(v.tobytes(), digest_size=8).digest(), "little", signed=True) for v in x], np.int64)
                yield pa.record_batch([pa.array(ids[r]), pa.array(asked_by[r]), pa.array(vec), pa.array(score)], ["query_id", "asked", "vec_id", "score"])

    found = pairs.mapInArrow(search, "query_id long, asked long, vec_id long, score double")
    order = Window.partitionBy("query_id", "asked").orderBy(F.isnan("score"), F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3_neighbours(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector."""
    vectors = S.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), 20)
