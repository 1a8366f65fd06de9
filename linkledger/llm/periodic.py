"""Periodic runs of words: harmonic grid probing.

A run is a stretch of words with smallest period q, at least max(LEAST, TIMES * q) words
long, that can't be made longer at either end. A run of period p holds four multiples of
p in a row, wherever it begins, so for each p the words at jp and (j + 1)p are tested for
equality, and what agrees three times in a row survives: some n log n tests of n words.
Survivors are compared with the words p further on, first all of them in short pieces,
then one after the other in chunks of growing size, up to where the stretch ends. Grid
points in a run that was found before, of a period that divides p, are passed over: they
can only give that run again. Any other run agrees with a stretch of period p in fewer
than p + q words, so a survivor in it ends after fewer than q comparisons. Periods go up,
so the first period that a stretch is found with is its smallest.

Documents of a slab are probed at once, the long ones first, so that each period meets
only documents that can hold a run of it. Words are compared as whole byte strings, by
their numbers in the slab's dictionary.

A word is dropped by `collapse` if any run holds it after that run's first q words.

Defined cases: null and blank texts have no words, no runs and an empty collapsed text;
runs may overlap, and each is listed once, by start, then period; repeated rows get equal
results; an empty table gives an empty result; very long texts are whole: memory grows
with a slab or with the longest text; all columns are passed on, whatever their names, and
a column with the result's name is replaced. There is no shuffle, so no key can be hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from . import _spark as S
from .secrets import let

#: Words of a run at least, and periods.
LEAST, TIMES = 6, 4
#: Words that all survivors of a period are compared in together, words of the first chunk and of the largest.
TOGETHER, CHUNK, MOST = 64, 64, 1 << 16
#: Bytes of text probed at once, about.
SLAB = 2 << 20
WORD = r"[^\x20\x09-\x0D]+"
RESULT = "struct<runs:array<struct<start:long,length:long,period:long>>,collapsed:string>"
_WORDS = B.Words(B.SPACES, fold=False)


def stretch(words: np.ndarray, x: int, p: int, low: int, high: int) -> tuple[int, int]:
    """The widest [a, b) within [low, high) that holds x and x + p and in which words p apart are identical."""
    i, size = x, CHUNK
    while (n := min(size, high - p - i)) > 0:
        differ = words[i : i + n] != words[i + p : i + p + n]
        if differ.any():
            i += int(differ.argmax())
            break
        i, size = i + n, min(2 * size, MOST)
    a, size = x, CHUNK
    while (n := min(size, a - low)) > 0:
        differ = words[a - n : a] != words[a - n + p : a + p]
        if differ.any():
            a -= int(differ[::-1].argmax())
            break
        a, size = a - n, min(2 * size, MOST)
    return a, i + p


def inside(x: np.ndarray, reach: int, runs: tuple[list[int], list[int]]) -> np.ndarray:
    """Which [x, x + reach] lie in one of the runs (starts, ends) of a period; such runs overlap in fewer words than a period."""
    starts, ends = np.array(runs[0]), np.array(runs[1])
    at = np.searchsorted(starts, x, side="right") - 1
    return (at >= 0) & (x + reach < ends[at])


def find_runs(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(document, start, length, period) of all runs, ordered by these but for the length; `first`: the first word of each document, one more at the end."""
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] >= LEAST]
    n = sizes[order]
    if not len(n):
        return np.zeros((0, 4), np.int64)
    ends = np.cumsum(n)
    begins = ends - n
    words = words[np.arange(ends[-1]) + np.repeat(first[order] - begins, n)]
    found: dict[int, tuple[list[int], list[int]]] = {}
    out, held = [], len(n)
    for p in range(1, int(n[0]) // TIMES + 1):
        least = max(LEAST, TIMES * p)
        while n[held - 1] < least:
            held -= 1
        grid = words[: ends[held - 1] : p]
        agree = grid[1:] == grid[:-1]
        agree = agree[2:] & agree[1:-1] & agree[:-2]
        if not agree.any():
            continue
        x = np.flatnonzero(agree) * p
        x = x[x + 3 * p < ends[np.searchsorted(begins, x, side="right") - 1]]
        for q, runs in found.items():
            if len(x) and p % q == 0:
                x = x[~inside(x, 3 * p, runs)]
        done, step = 1, 8
        while len(x) and done <= min(2 * p, TOGETHER):
            k = np.arange(done, min(done + step, 2 * p + 1, TOGETHER + 1))
            x = x[(words[x[:, None] + k] == words[x[:, None] + k + p]).all(1)]
            done, step = done + step, 2 * step
        own: tuple[list[int], list[int]] = ([], [])
        passed = -1
        for y in x.tolist():
            if y < passed:
                continue
            d = int(np.searchsorted(begins, y, side="right")) - 1
            a, b = stretch(words, y, p, int(begins[d]), int(ends[d]))
            passed = b - p
            if b - a >= least:
                own[0].append(a)
                own[1].append(b)
                out.append((int(order[d]), a - int(begins[d]), b - a, p))
        if own[0]:
            found[p] = own
    runs = np.array(out, np.int64).reshape(-1, 4)
    return runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]


def collapsed(column: pa.Array) -> Iterator[tuple[int, int, pa.Array]]:
    """(first text, first beyond, their results as RESULT has them), slab by slab."""
    buf, off = B.text_bytes(column)
    for lo, hi in B.slabs(off, SLAB):
        text, to = buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        starts, ends, first = _WORDS.find(text, to)
        sizes = ends - starts
        letters = text[_WORDS.inside[text]]  # of all words, one after the other
        known = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)), pa.py_buffer(letters)]).dictionary_encode()
        runs = find_runs(known.indices.to_numpy(zero_copy_only=False), first)
        at = first[runs[:, 0]] + runs[:, 1]
        change = np.zeros(len(starts) + 1, np.int64)
        np.add.at(change, at + runs[:, 3], 1)
        np.add.at(change, at + runs[:, 2], -1)
        kept = np.cumsum(change[:-1]) == 0
        # kept words, each with a space behind but the last one of its document
        before = np.concatenate([[0], np.cumsum(kept)])[first]
        room = sizes[kept] + 1
        room[before[1:][before[1:] > before[:-1]] - 1] -= 1
        reach = np.concatenate([[0], np.cumsum(room)])
        joined = np.full(reach[-1], 0x20, np.uint8)
        space = np.zeros(reach[-1], bool)
        space[(reach[:-1] + sizes[kept])[room > sizes[kept]]] = True
        joined[~space] = letters[np.repeat(kept, sizes)]
        texts = pa.Array.from_buffers(pa.large_string(), hi - lo, [None, pa.py_buffer(reach[before].astype(np.int64)), pa.py_buffer(joined)]).cast(pa.string())
        fields = pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in (1, 2, 3)], ["start", "length", "period"])
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(runs[:, 0], np.arange(hi - lo + 1)), pa.int32()), fields)
        yield lo, hi, pa.StructArray.from_arrays([lists, texts], ["runs", "collapsed"])


def collapse(docs: DataFrame, result: str = "periodic", text: str = "text") -> DataFrame:
    """docs with `result`, as RESULT has it: all runs of words, by start, then period, and the text without what repeats in them."""
    docs = docs.drop(result)
    at = docs.columns.index(text)
    schema = docs.withColumn(result, F.lit(None).cast(RESULT)).schema

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, found in collapsed(batch.column(at)):
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, found], [*batch.schema.names, result])

    return docs.mapInArrow(each, schema)


def strongest(runs: Column) -> Column:
    """The run with the greatest exact length / period, the first of equal ones; null without runs."""
    better = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    return F.aggregate(runs, F.lit(None).cast("struct<start:long,length:long,period:long>"), better)


def planted(doc_id: Column, text: Column) -> Column:
    """The text, of which a tenth of the documents, by their ids, repeat some words from some word on to the end."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("long")
        place = F.struct((g % n).alias("a"), n.alias("n"))
        return let(place, lambda s: let(1 + F.floor((s["n"] - s["a"]) / (3 + g % 8)), lambda p: F.array_join(F.transform(words, lambda w, i: F.when(i < s["a"], w).otherwise(F.get(words, (s["a"] + (i - s["a"]) % p).cast("int")))), " ")))

    return F.when((h % 10 == 0) & text.rlike(WORD), let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), repeated)).otherwise(text)


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Every document's periodic runs, its strongest one, and digests of all of them and of the text without them."""
    docs = S.table(spark, sf_dir, "documents").select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    found = collapse(docs).select("doc_id", "periodic.runs", "periodic.collapsed").withColumn("best", strongest(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))), "")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
