"""Benchmark decontamination by winnowing.

A benchmark item is cut into windows of `window` words (an item of fewer words is one
window). The fingerprint of a window is the smallest hash of its `gram`-word grams, so
whatever text holds a window also holds its fingerprint: no shared span of `window`
words can be missed. Documents are scanned once; where a document's fingerprint is a
benchmark fingerprint, the hit is extended to the whole window and compared with the
benchmark's windows.

Fingerprints of training texts are joined with those of the benchmark inside the scan,
against a broadcast part of the benchmark of at most `part_windows` windows. A larger
benchmark is read in several such parts, one scan each, and hits are merged by row. Parts
are dealt by item and window, so neither a long item nor a window of many items makes one large.

Defined cases: null or wordless texts have no words and are never contaminated; an
empty benchmark hits nothing, and an empty table gives an empty result; items with the
same text are all reported; items without id or text are left out; repeated rows get equal
results; very long texts are read whole; other columns of the documents pass through,
whatever their names.
Memory: one slab of texts, or the longest document, beside the broadcast part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from . import _spark as S

WINDOW, GRAM = 13, 5
#: Windows in one broadcast part, about: 32 bytes each, so 32 MB.
PART_WINDOWS = 1_000_000
#: Fixed value: bytes that are no part of a word.
SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
#: Capital letters are folded before words are taken, so they are inside words.
SEPARATORS = bytes(b for b in SEPARATORS if not 0x41 <= b <= 0x5A)
WORDS = B.Words(SEPARATORS, seed=2)
RESULT = "struct<n_words:long,starts:array<int>,ends:array<int>,items:array<long>>"


def smallest(values: np.ndarray, n: int) -> np.ndarray:
    """The smallest of each n consecutive values."""
    m = len(values) - n + 1
    if m <= 0:
        return values[:0]
    out = values[:m].copy()
    for k in range(1, n):
        np.minimum(out, values[k : k + m], out=out)
    return out


def fingerprints(hashes: np.ndarray, window: int, gram: int) -> np.ndarray:
    """The winnowed fingerprint of each `window` consecutive words."""
    gram = min(gram, window)
    return smallest(B.spans_of(hashes, gram), window - gram + 1)


def _windows(window: int, gram: int):
    """The distinct windows of each item, with the fingerprints of full ones."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = B.text_bytes(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi in B.slabs(off):
                part, inner = buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                starts, ends, first = WORDS.find(part, inner)
                hashes = WORDS.hash(part, starts, ends)
                for d in range(hi - lo):
                    own = hashes[first[d] : first[d + 1]]
                    n = min(window, len(own))
                    if n:
                        spans, at = np.unique(B.spans_of(own, n), return_index=True)
                        prints = fingerprints(own, window, gram)[at].view(np.int64) if n == window else np.zeros(len(spans), np.int64)
                        yield pa.record_batch([pa.array(np.full(len(spans), ids[lo + d])), pa.array(np.full(len(spans), n, np.int32)), pa.array(spans.view(np.int64)), pa.array(prints)], ["item_id", "n", "span", "print"])

    return of


def _scan(known, window: int, gram: int):
    """The UDF that finds hits of one broadcast part: (fingerprints, {n: (spans, items)}), all sorted."""

    def scan(texts: pa.Array) -> pa.Array:
        prints, tables = known.value
        buf, off = B.text_bytes(texts)
        n_words, starts_of, ends_of, items_of = [], [], [], []
        for lo, hi in B.slabs(off):
            part, inner = buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
            starts, ends, first = WORDS.find(part, inner)
            hashes = WORDS.hash(part, starts, ends)
            hits = []
            for n, (spans, items) in tables.items():
                m = len(hashes) - n + 1
                if m <= 0:
                    continue
                inside, of = B.start_document(first, n, m)
                if n == window:
                    at = np.flatnonzero(B.same(fingerprints(hashes, window, gram), prints) & inside)
                    own = B.spans_of(hashes, n) if len(at) > m // 8 else None
                    got = own[at] if own is not None else _spans_at(hashes, at, n)
                else:
                    at = np.flatnonzero(inside)
                    got = B.spans_of(hashes, n)[at]
                true = B.same(got, spans)
                at, got = at[true], got[true]
                if len(at):
                    hits.append((of[at], at, np.full(len(at), n), got))
            n_words += np.diff(first).tolist()
            by = {}
            if hits:
                docs, at, n, got = (np.concatenate(x) for x in zip(*hits, strict=True))
                order = np.lexsort((at, docs))
                docs, at, n, got = docs[order], at[order], n[order], got[order]
                cuts = np.flatnonzero(np.diff(docs)) + 1
                for one in np.split(np.arange(len(docs)), cuts):
                    d = int(docs[one[0]])
                    ranges = merged(at[one] - first[d], at[one] - first[d] + n[one])
                    items: set[int] = set()
                    for k in set(n[one].tolist()):
                        spans, owners = tables[k]
                        own = np.unique(got[one][n[one] == k])
                        for a, b in zip(np.searchsorted(spans, own, "left"), np.searchsorted(spans, own, "right"), strict=True):
                            items.update(owners[a:b].tolist())
                    by[d] = (*ranges, sorted(items))
            for d in range(hi - lo):
                a, b, items = by.get(d, ([], [], []))
                starts_of.append(a)
                ends_of.append(b)
                items_of.append(items)
        return pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(starts_of, pa.list_(pa.int32())), pa.array(ends_of, pa.list_(pa.int32())), pa.array(items_of, pa.list_(pa.int64()))], ["n_words", "starts", "ends", "items"])

    def typed(texts):
        return scan(texts)

    typed.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(typed, RESULT).asNondeterministic()


def _spans_at(hashes: np.ndarray, at: np.ndarray, n: int, factor: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    out = np.zeros(len(at), B.U64)
    for k in range(n):
        out *= B.U64(factor)
        out += hashes[at + k]
    return B.mix(out + B.U64(n))


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[list[int], list[int]]:
    """The union of ranges, given by ascending starts."""
    reach = np.maximum.accumulate(ends)
    new = np.concatenate([[True], starts[1:] > reach[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(starts) - 1]])
    return starts[new].tolist(), reach[last].tolist()


def find_hits(docs: DataFrame, benchmark: DataFrame, result: str, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM, part_windows: int = PART_WINDOWS) -> DataFrame:
    """docs with a column `result`: n_words, hit word ranges (starts, ends) and the items with occurring windows, ascending."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    windows = S.cut(items.mapInArrow(_windows(window, gram), "item_id long, n int, span long, print long").distinct())
    parts = max(1, -(-windows.count() // part_windows))
    part_of = F.pmod(F.xxhash64("item_id", "span"), F.lit(parts))
    found = None
    for k in range(parts):
        own = windows.where(part_of == k).toPandas()  # part_windows rows, about
        prints = np.unique(own.loc[own["n"] == window, "print"].to_numpy(np.int64))
        tables = {}
        for n, rows in own.groupby("n"):
            spans, ids = rows["span"].to_numpy(np.int64).view(B.U64), rows["item_id"].to_numpy(np.int64)
            order = np.lexsort((ids, spans))
            tables[int(n)] = (spans[order], ids[order])
        known = spark.sparkContext.broadcast((np.sort(prints.view(B.U64)), tables))
        hits = docs.withColumn(result, _scan(known, window, gram)(F.col(text)))
        if parts == 1:
            return hits
        key = S.free_name(docs, "_row")
        # a text's parts meet by 128 bits of it; null is a text of its own
        name = F.coalesce(F.md5(F.col(text).cast("binary")), F.lit("null"))
        hits = hits.withColumn(key, name)
        if found is None:
            base, found = docs.withColumn(key, name), None
        hits = hits.select(key, result).where((F.size(F.col(result)["items"]) > 0) | (F.lit(k) == 0)).dropDuplicates([key])
        found = hits if found is None else found.unionByName(hits)
    merged_hits = found.groupBy(key).agg(F.max(F.col(result)["n_words"]).alias("n_words"), F.flatten(F.collect_list(F.arrays_zip(F.col(result)["starts"].alias("s"), F.col(result)["ends"].alias("e")))).alias("ranges"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.col(result)["items"])))).alias("items"))
    union = F.expr("aggregate(array_sort(ranges), array(struct(cast(-2 as int) as s, cast(-2 as int) as e)), (a, r) -> if(r.s <= element_at(a, -1).e, concat(slice(a, 1, size(a) - 1), array(struct(element_at(a, -1).s as s, greatest(element_at(a, -1).e, r.e) as e))), concat(a, array(struct(r.s as s, r.e as e)))), a -> slice(a, 2, size(a)))")
    merged_hits = merged_hits.withColumn("ranges", union).select(key, F.struct("n_words", F.col("ranges.s").alias("starts"), F.col("ranges.e").alias("ends"), "items").alias(result))
    return base.join(merged_hits, key).drop(key)


def n_hit(result: str):
    return F.aggregate(F.arrays_zip(F.col(result)["starts"].alias("s"), F.col(result)["ends"].alias("e")), F.lit(0).cast("long"), lambda a, r: a + r["e"] - r["s"])


def contaminated(result: str):
    """Any word hit, and a twentieth of the words at least."""
    return (n_hit(result) > 0) & (20 * n_hit(result) >= F.col(result)["n_words"])


def clean_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """docs without those that are contaminated; all their columns."""
    result = S.free_name(docs, "_hits")
    return find_hits(docs, benchmark, result, text).where(~contaminated(result)).drop(result)


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = S.table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = find_hits(docs, S.table(spark, sf_dir, "benchmark"), "hits")
    return hits.select(
        "doc_id",
        F.col("hits.n_words").alias("n_words"),
        n_hit("hits").alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort(F.transform(F.col("hits.items"), lambda x: x.cast("string")))), 256).alias("items_sha256"),
        contaminated("hits").alias("contaminated"),
    )
