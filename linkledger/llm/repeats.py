"""Removal of repeated byte strings by suffixes sampled at a difference cover.

Every byte covered by a string of LENGTH bytes that also starts elsewhere is removed.

1. Sample: suffixes at positions of a difference cover modulo MODULUS. Of two equal
   strings of LENGTH bytes, some position less than MODULUS bytes on is sampled in both,
   and LENGTH - MODULUS + 1 bytes from there lie in both. These tuples get names, which
   are dealt to buckets and sorted; names next to an equal one are repeated.
2. What starts within reach of no repeated tuple is done. A tuple and the bytes before it
   make up a whole string of LENGTH bytes, so names of names, the recursion of a complete
   suffix order, have nothing left to tell. Of the texts that have repeated tuples, the
   starts in reach of one are kept as runs.
3. Merge: the remaining suffixes meet by the least hash of the GRAM-byte strings in
   their first LENGTH bytes, so that a run travels as one piece of text, not as a name
   for each start. In each bucket they are put in the order of the names of their first
   LENGTH bytes, and neighbours with one name are compared byte by byte.

So this is not a complete suffix array: suffixes are ordered by names, not by their bytes,
and only as far as LENGTH bytes. A complete order takes records of 16 bytes or more for
each byte of text in every round of sorting, which no limit on disk of a few times the
input allows.

Texts are known by their hash. Equal texts are one text that is repeated as a whole.
Hashes that hold more than a thousandth of all pieces are not gathered: there, each
start is sent by two names of its string, 128 bits, once for each cell of texts.

Defined cases: null texts are empty; texts shorter than LENGTH stay as they are;
overlaps of a string with itself count; repeated rows are removed in all copies, the
first included; empty tables give empty results; very long texts are whole, one in a
task's memory at a time; extra columns, whatever their names, are not read. Names of
samples only choose what is compared. Memory: a slab of texts or the longest text, or a
bucket of about BUCKET bytes of pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from . import _spark as S
from .sketch import in_sketch, sketch_of

LENGTH = 200
#: A difference cover; every residue is a difference of two members.
MODULUS, COVER = 91, np.array([0, 1, 3, 9, 27, 49, 56, 61, 77, 81])
TUPLE = LENGTH - MODULUS + 1
GRAM = 16
#: Bytes of text in a slab of samples and in a cell, and of text or of pieces for each bucket.
SLAB, CELL, TEXT_BUCKET, BUCKET = 8 << 20, 2 << 20, 16 << 20, 8 << 20
_VALUE, _SECOND = B.byte_values(21), B.byte_values(22)
_AT = np.full(MODULUS, -1)
_AT[COVER] = np.arange(len(COVER))


class Names:
    """Names of strings in a buffer, by the sums of its bytes' values."""

    def __init__(self, buf: np.ndarray, values: np.ndarray = _VALUE) -> None:
        self.sums = np.zeros(len(buf) + 1, B.U64)
        np.cumsum(values[buf] * B.power_table(B.BASE, len(buf)), out=self.sums[1:])
        self.inverse = B.power_table(B.INVERSE, len(buf) + 1)

    def at(self, starts: np.ndarray, n: int) -> np.ndarray:
        return B.mix((self.sums[starts + n] - self.sums[starts]) * self.inverse[starts])

    def all(self, n: int) -> np.ndarray:
        """The names of all strings of n bytes, wherever they start."""
        return B.mix((self.sums[n:] - self.sums[:-n]) * self.inverse[: len(self.sums) - n])


def least_of(values: np.ndarray, n: int) -> np.ndarray:
    """The smallest of each n consecutive values, in about log2(n) passes."""
    out, width = values, 1
    while width < n:
        step = min(width, n - width)
        out = np.minimum(out[:-step], out[step:])
        width += step
    return out


def zipped(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.astype("<u4").tobytes())


def unzipped(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<u4").astype(np.int64)


def lists(counts: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)


# 1. samples

SAMPLES = "bucket int, known boolean, keys array<long>, counts array<int>, names binary, given binary, ordinals binary"


def _samples(buckets: int):
    """Rows for each bucket: samples (text, ordinal, name) to ask for, or already known to be repeated."""

    def rows_of(keys: np.ndarray, doc: np.ndarray, ordinal: np.ndarray, name: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(name):
            return
        order = np.argsort(name, kind="stable")
        equal = name[order][1:] == name[order][:-1]
        local = np.zeros(len(name), bool)
        local[order[1:]] |= equal
        local[order[:-1]] |= equal
        first = np.zeros(len(name), bool)  # one of each name that is repeated inside the slab
        first[order] = np.concatenate([[True], ~equal])
        first &= local
        bucket = ((name >> B.U64(32)) % B.U64(buckets)).astype(np.int32)
        spread = np.full(len(name), (np.arange(len(name)) // 65536 + int(keys[0])) % buckets, np.int32)
        for known in (False, True):
            at = np.flatnonzero(local if known else ~local)
            where = spread if known else bucket
            at = at[np.argsort(where[at], kind="stable")]  # texts and ordinals ascend in each bucket
            given = np.flatnonzero(first) if not known else first[:0].nonzero()[0]
            given = given[np.argsort(bucket[given], kind="stable")]
            for b in np.union1d(where[at], bucket[given]).tolist():
                own = at[np.searchsorted(where[at], b) : np.searchsorted(where[at], b, "right")]
                more = given[np.searchsorted(bucket[given], b) : np.searchsorted(bucket[given], b, "right")]
                new = np.diff(doc[own], prepend=-1) != 0
                starts = np.flatnonzero(new)
                counts = np.diff(np.append(starts, len(own)))
                delta = np.diff(ordinal[own], prepend=0)
                delta[starts] = ordinal[own][starts]
                names = b"" if known else (name[own] & B.U64(0xFFFFFFFF)).astype("<u4").tobytes()
                yield pa.record_batch([pa.array([b], pa.int32()), pa.array([known]), lists(np.array([len(starts)]), pa.array(keys[doc[own][starts]])), lists(np.array([len(starts)]), pa.array(counts.astype(np.int32))), pa.array([names], pa.binary()), pa.array([(name[more] & B.U64(0xFFFFFFFF)).astype("<u4").tobytes()], pa.binary()), pa.array([zipped(delta)], pa.binary())], [c.split()[0] for c in SAMPLES.split(", ")])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            if held:
                keys = np.concatenate([h[0] for h in held])
                base = np.cumsum([0, *(len(h[0]) for h in held[:-1])])
                yield from rows_of(keys, np.concatenate([h[1] + b for h, b in zip(held, base, strict=True)]), *(np.concatenate([h[k] for h in held]) for k in (2, 3)))
            held, size = [], 0

        for batch in batches:
            keys = batch.column(0).to_pylist()
            new = [k for k, i in enumerate(keys) if i not in seen and not seen.add(i)]
            batch = batch.take(pa.array(new, pa.int64()))
            keys = batch.column(0).to_numpy()
            buf, off = B.text_bytes(batch.column(1))
            for lo, hi in B.slabs(off):
                part, inner = buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                sizes = np.diff(inner)
                doc = np.repeat(np.arange(hi - lo), sizes)
                local = np.arange(len(part)) - inner[:-1][doc]
                p = np.flatnonzero((_AT[local % MODULUS] >= 0) & (local + TUPLE <= sizes[doc]) & (sizes[doc] >= LENGTH))
                held.append((keys[lo:hi], doc[p], local[p] // MODULUS * len(COVER) + _AT[local[p] % MODULUS], Names(part).at(p, TUPLE)))
                size += len(part)
                if size >= SLAB:
                    yield from flush()
        yield from flush()

    return of


def _repeated_samples(table: pa.Table) -> pa.Table:
    """(text, ordinals) of the samples in a bucket whose name another place has."""
    rows = table.to_batches()
    names, forced, owner, ordinal, ask = [], [], [], [], []
    for batch in rows:
        for k in range(len(batch)):
            row = {c: batch.column(i)[k] for i, c in enumerate(batch.schema.names)}
            keys, counts = row["keys"].values.to_numpy(), row["counts"].values.to_numpy().astype(np.int64)
            delta = unzipped(row["ordinals"].as_py())
            total = np.cumsum(delta)
            starts = np.cumsum(counts) - counts
            own = total - np.repeat(total[starts] - delta[starts], counts) if len(starts) else total
            known = row["known"].as_py()
            mine = np.frombuffer(row["names"].as_buffer(), "<u4")
            given = np.frombuffer(row["given"].as_buffer(), "<u4")
            names += [np.zeros(len(own), "<u4") if known else mine, given]
            ask += [np.full(len(own), not known), np.ones(len(given), bool)]
            forced += [np.zeros(len(own), bool), np.ones(len(given), bool)]
            owner += [np.repeat(keys, counts), np.zeros(len(given), np.int64)]
            ordinal += [own, np.full(len(given), -1)]
    names, forced, owner, ordinal, ask = (np.concatenate(x) for x in (names, forced, owner, ordinal, ask))
    place = B.mix(owner.view(B.U64) * B.U64(B.BASE) + ordinal.astype(B.U64))
    at = np.flatnonzero(ask)
    order = at[np.argsort(names[at], kind="stable")]
    good = ~ask
    if len(order):
        sorted_ = names[order]
        heads = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
        low, high = np.minimum.reduceat(place[order], heads), np.maximum.reduceat(place[order], heads)
        yes = (low != high) | np.logical_or.reduceat(forced[order], heads)
        good[order] = np.repeat(yes, np.diff(np.append(heads, len(order))))
    good &= ordinal >= 0
    owner, ordinal = owner[good], ordinal[good]
    heads = np.flatnonzero(np.diff(owner, prepend=owner[0] - 1 if len(owner) else 0) != 0) if len(owner) else np.zeros(0, np.int64)
    return pa.table([pa.array(owner[heads]), lists(np.diff(np.append(heads, len(owner))) if len(heads) else heads, pa.array(ordinal.astype(np.int32)))], ["key", "at"])


def repeated_samples(texts: DataFrame) -> DataFrame:
    """(key, at): ordinals of repeated samples of texts (key, text), a text's in several rows and perhaps several times."""
    total = texts.select(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    buckets = max(32, -(-total // TEXT_BUCKET))
    asked = texts.mapInArrow(_samples(buckets), SAMPLES).repartition(buckets, "bucket")
    return S.written(asked.groupBy("bucket").applyInArrow(_repeated_samples, "key long, at array<int>"))


# 2. the texts that have repeated samples, packed in cells

CELLS = "cell long, keys array<long>, sizes array<int>, text binary, starts binary, lengths binary, least binary, n_starts long"


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of a cell, and the runs of starts in reach of a repeated sample: start, length and least hash."""

    def packed(keys: list[int], texts: list[bytes], ats: list[np.ndarray]) -> pa.RecordBatch:
        buf = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.array([len(t) for t in texts])
        begin = np.cumsum(sizes) - sizes
        doc = np.repeat(np.arange(len(keys)), [len(a) for a in ats])
        ordinal = np.concatenate(ats)
        p = ordinal // len(COVER) * MODULUS + COVER[ordinal % len(COVER)]
        low, high = begin[doc] + np.maximum(p - MODULUS + 1, 0), begin[doc] + np.minimum(p, sizes[doc] - LENGTH) + 1
        fine = high > low
        step = np.zeros(len(buf) + 1, np.int32)
        np.add.at(step, low[fine], 1)
        np.add.at(step, high[fine], -1)
        starts = np.flatnonzero(np.cumsum(step[:-1]) > 0)
        least = least_of(Names(buf).all(GRAM), LENGTH - GRAM + 1)[starts] if len(starts) else np.zeros(0, B.U64)
        heads = np.flatnonzero(np.concatenate([[True], (starts[1:] != starts[:-1] + 1) | (least[1:] != least[:-1])])) if len(starts) else starts
        lengths = np.diff(np.append(heads, len(starts)))
        values = [pa.array([keys[0]], pa.int64()), pa.array([keys], pa.list_(pa.int64())), pa.array([sizes.tolist()], pa.list_(pa.int32())), pa.array([buf.tobytes()], pa.binary()), pa.array([zipped(starts[heads])], pa.binary()), pa.array([zipped(lengths)], pa.binary()), pa.array([least[heads].tobytes()], pa.binary()), pa.array([len(starts)], pa.int64())]
        return pa.record_batch(values, [c.split()[0] for c in CELLS.split(", ")])

    keys, texts, ats, size = [], [], [], 0
    for batch in batches:
        for key, text, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            keys.append(key)
            texts.append(text)
            ats.append(at.values.to_numpy().astype(np.int64))
            size += len(text)
            if size >= CELL:
                yield packed(keys, texts, ats)
                keys, texts, ats, size = [], [], [], 0
    if keys:
        yield packed(keys, texts, ats)


def cells_of(texts: DataFrame, found: DataFrame) -> DataFrame:
    sketch = sketch_of(found, "key")

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            wanted = in_sketch(sketch, batch.column(0))
            new = [k for k in np.flatnonzero(wanted).tolist() if (i := batch.column(0)[k].as_py()) not in seen and not seen.add(i)]
            yield batch.take(pa.array(new, pa.int64()))

    bodies = texts.select("key", F.col("text").cast("binary").alias("text")).mapInArrow(picked, "key long, text binary").groupBy("key").agg(F.first("text").alias("text"))
    at = found.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"))
    return S.written(bodies.join(at, "key").select("key", "text", "at").mapInArrow(_cells, CELLS))


class Cell:
    """A cell's texts and runs, in the order in which its starts are asked for and answered."""

    def __init__(self, row: dict, hot: np.ndarray, buckets: int) -> None:
        self.buf = np.frombuffer(row["text"].as_buffer(), np.uint8)
        starts, lengths = unzipped(row["starts"].as_py()), unzipped(row["lengths"].as_py())
        least = np.frombuffer(row["least"].as_buffer(), B.U64)
        warm = np.isin(least, hot) if len(hot) else np.zeros(len(least), bool)
        bucket = (B.mix(least + B.U64(1)) % B.U64(buckets)).astype(np.int64)
        order = np.flatnonzero(~warm)
        self.runs = order[np.argsort(bucket[order], kind="stable")]
        self.bucket, self.starts, self.lengths = bucket[self.runs], starts[self.runs], lengths[self.runs]
        self.hot_starts = self.spread(starts[warm], lengths[warm])
        if len(self.hot_starts):
            self.names, first, self.which, self.count = np.unique(Names(self.buf).at(self.hot_starts, LENGTH), return_index=True, return_inverse=True, return_counts=True)
            self.second = Names(self.buf, _SECOND).at(self.hot_starts[first], LENGTH)
            self.name_bucket = (self.names % B.U64(buckets)).astype(np.int64)
            self.by_name = np.argsort(self.name_bucket, kind="stable")

    @staticmethod
    def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """starts, starts + 1, ... of each run."""
        to = np.cumsum(lengths)
        return np.arange(to[-1] if len(to) else 0) + np.repeat(starts - (to - lengths), lengths)


def cell_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(len(batch)):
            yield {c: batch.column(i)[k] for i, c in enumerate(batch.schema.names)}


# 3. the remaining suffixes

PIECES = "bucket int, cell long, named boolean, lengths binary, data binary"


def _pieces(hot, buckets: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for row in cell_rows(batches):
            cell, name = Cell(row, hot.value, buckets), row["cell"].as_py()
            out = []
            for b in np.unique(cell.bucket).tolist():
                own = slice(np.searchsorted(cell.bucket, b), np.searchsorted(cell.bucket, b, "right"))
                text = cell.buf[Cell.spread(cell.starts[own], cell.lengths[own] + LENGTH - 1)]
                out.append((b, name, False, zipped(cell.lengths[own]), pack.compress(text.tobytes())))
            if len(cell.hot_starts):
                by = cell.name_bucket[cell.by_name]
                for b in np.unique(by).tolist():
                    own = cell.by_name[np.searchsorted(by, b) : np.searchsorted(by, b, "right")]
                    out.append((b, name, True, cell.second[own].tobytes(), cell.names[own].tobytes()))
            if out:
                kinds = [pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()]
                yield pa.record_batch([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], [c.split()[0] for c in PIECES.split(", ")])

    return of


def _same_bytes(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the LENGTH bytes at a and at b are equal, place by place."""
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, 8)).view(B.U64).ravel()
    out = np.ones(len(a), bool)
    for lo in range(0, len(a), 1 << 18):
        x, y, own = a[lo : lo + (1 << 18)], b[lo : lo + (1 << 18)], out[lo : lo + (1 << 18)]
        for k in range(0, LENGTH, 8):
            own &= words[x + k] == words[y + k]
    return out


def _repeated(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which of the strings of LENGTH bytes at `starts` are there twice or more."""
    names = Names(text).at(starts, LENGTH)
    order = np.argsort(names, kind="stable")
    equal = np.flatnonzero(names[order][1:] == names[order][:-1])
    same = _same_bytes(text, starts[order[equal]], starts[order[equal + 1]])
    yes = np.zeros(len(starts), bool)
    yes[order[equal[same]]] = yes[order[equal[same] + 1]] = True
    for name in np.unique(names[order[equal[~same]]]):  # different strings of one name
        own = np.flatnonzero(names == name)
        strings = [text[s : s + LENGTH].tobytes() for s in starts[own].tolist()]
        yes[own] = [strings.count(x) > 1 for x in strings]
    return yes


def _answers(table: pa.Table) -> pa.Table:
    """For each row of a bucket, bits that tell which of its starts, or names, are repeated."""
    rows = [{c: table.column(c)[k] for c in table.column_names} for k in range(len(table))]
    out: list[tuple] = []
    for named in (False, True):
        own = [r for r in rows if r["named"].as_py() == named]
        if not own:
            continue
        if named:
            sizes = [len(r["data"].as_buffer()) // 8 for r in own]
            names, second = (np.concatenate([np.frombuffer(r[c].as_buffer(), B.U64) for r in own]) for c in ("data", "lengths"))
            order = np.lexsort((second, names))
            equal = (names[order][1:] == names[order][:-1]) & (second[order][1:] == second[order][:-1])
            yes = np.zeros(len(names), bool)
            yes[order[1:]] |= equal
            yes[order[:-1]] |= equal
        else:
            unpack, texts, starts, at = zstandard.ZstdDecompressor(), [], [], 0
            for r in own:
                text, lengths = np.frombuffer(unpack.decompress(r["data"].as_py()), np.uint8), unzipped(r["lengths"].as_py())
                whole = lengths + LENGTH - 1
                texts.append(text)
                starts.append(at + Cell.spread(np.cumsum(whole) - whole, lengths))
                at += len(text)
            sizes = [len(s) for s in starts]
            yes = _repeated(np.concatenate(texts), np.concatenate(starts))
        for r, bits in zip(own, np.split(yes, np.cumsum(sizes)[:-1]), strict=True):
            out.append((r["cell"].as_py(), r["bucket"].as_py(), named, np.packbits(bits).tobytes()))
    kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.binary()]
    return pa.table([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], ["cell", "bucket", "named", "bits"])


RESULT = "key long, n_removed long, n_spans long, kept_sha256 string, starts array<int>, ends array<int>"


def _removed(hot, buckets: int):
    """The spans to remove of each text of a cell that has any."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in cell_rows(batches):
            cell = Cell(row, hot.value, buckets)
            start = np.zeros(len(cell.buf) + 1, np.int32)
            for a in row["answers"].as_py():
                bits = np.unpackbits(np.frombuffer(a["bits"], np.uint8)).astype(bool)
                if a["named"]:
                    own = cell.by_name[np.searchsorted(cell.name_bucket[cell.by_name], a["bucket"]) : np.searchsorted(cell.name_bucket[cell.by_name], a["bucket"], "right")]
                    yes = np.zeros(len(cell.names), bool)
                    yes[own] = bits[: len(own)]
                    at = cell.hot_starts[yes[cell.which]]
                else:
                    own = slice(np.searchsorted(cell.bucket, a["bucket"]), np.searchsorted(cell.bucket, a["bucket"], "right"))
                    at = Cell.spread(cell.starts[own], cell.lengths[own])
                    at = at[bits[: len(at)]]
                start[at] = 1
            if len(cell.hot_starts):
                start[cell.hot_starts[cell.count[cell.which] > 1]] = 1
            at = np.flatnonzero(start)
            cover = np.zeros(len(cell.buf) + 1, np.int32)
            cover[at] = 1
            cover[at + LENGTH] -= 1
            gone = np.cumsum(cover[:-1]) > 0
            sizes = np.array(row["sizes"].as_py())
            to, out = np.cumsum(sizes), []
            for k, (a, b) in enumerate(zip((to - sizes).tolist(), to.tolist(), strict=True)):
                own = gone[a:b]
                if own.any():
                    edge = np.diff(own.astype(np.int8), prepend=0, append=0)
                    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                    out.append((row["keys"][k].as_py(), int(own.sum()), len(first), hashlib.sha256(cell.buf[a:b][~own].tobytes()).hexdigest(), first.tolist(), last.tolist()))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
                yield pa.record_batch([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], [c.split()[0] for c in RESULT.split(", ")])

    return of


def repeats_of(texts: DataFrame) -> DataFrame:
    """RESULT for each text of texts (key, text) that holds strings that also start elsewhere; equal texts count as one."""
    spark = texts.sparkSession
    cells = cells_of(texts, repeated_samples(texts))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in cell_rows(batches):
            own, n = np.unique(np.frombuffer(row["least"].as_buffer(), np.int64), return_counts=True)
            yield pa.record_batch([pa.array(own), pa.array(n.astype(np.int64))], ["least", "n"])

    pieces = S.cut(cells.select("least").mapInArrow(runs, "least long, n long").groupBy("least").agg(F.sum("n").alias("n")))
    n_pieces, n_starts = (pieces.agg(F.sum("n")).first()[0] or 0), (cells.agg(F.sum("n_starts")).first()[0] or 0)
    least = max(1000, n_pieces // 1000)
    hot = spark.sparkContext.broadcast(np.array([r["least"] for r in pieces.where(F.col("n") > least).select("least").collect()], np.int64).view(B.U64))  # a thousand at most
    buckets = max(64, -(-(n_starts + LENGTH * n_pieces) // BUCKET))
    asked = cells.select("cell", "text", "starts", "lengths", "least").mapInArrow(_pieces(hot, buckets), PIECES).repartition(buckets, "bucket")
    answers = asked.groupBy("bucket").applyInArrow(_answers, "cell long, bucket int, named boolean, bits binary")
    answers = answers.groupBy("cell").agg(F.collect_list(F.struct("bucket", "named", "bits")).alias("answers"))
    return S.written(cells.join(answers, "cell").drop("n_starts").mapInArrow(_removed(hot, buckets), RESULT))


#: Keys that several texts may share, and times that they are told apart; of 10 ** 11 texts, some hundred keys are, once.
SHARED, TURNS = 10_000, 4


def text_key(text: Column) -> Column:
    return F.xxhash64(text, F.octet_length(text))


def text_check(text: Column) -> Column:
    """A second hash, independent of the key."""
    return F.xxhash64(F.lit("check"), text)


def keyed(rows: DataFrame) -> DataFrame:
    """rows (text) with `key`, a long that differs wherever the two hashes of texts do: keys that texts of different checks share are replaced."""
    key, check = text_key(F.col("text")), text_check(F.col("text"))
    for turn in range(TURNS):
        told = rows.select(key.alias("key"), check.alias("check")).groupBy("key").agg(F.min("check").alias("low"), F.max("check").alias("high")).where("low < high")
        shared = [r["key"] for r in told.select("key").limit(SHARED + 1).collect()]  # by chance, hardly ever any
        if not shared:
            return rows.withColumn("key", key)
        if len(shared) > SHARED:
            break
        key = F.when(key.isin(shared), F.xxhash64(key, check, F.lit(turn))).otherwise(key)
    raise RuntimeError("texts can't be told apart by their hashes")


def find_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the removed spans' starts and ends in bytes."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = keyed(docs.select(F.col(doc_id).alias("doc_id"), body.alias("text")))
    found = repeats_of(rows.select("key", "text"))
    small = rows.select("doc_id", "key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("whole"))
    copies = small.groupBy("key").agg((F.count("*") > 1).alias("copied")).where("copied")
    # a row for each text of note, cut: so there is one join with the rows, both sides shuffled for it, and copies of one text can be split
    told = S.cut(copies.join(found, "key", "full"))
    joined = small.join(told, "key", "left")
    all_gone = F.coalesce(F.col("copied"), F.lit(False)) & (F.col("n_bytes") >= LENGTH)
    pick = lambda whole, part, none: F.when(all_gone, whole).when(F.col("n_removed").isNotNull(), part).otherwise(none)
    empty = F.array().cast("array<int>")
    return joined.select(
        "doc_id",
        "n_bytes",
        pick(F.col("n_bytes"), F.col("n_removed"), F.lit(0)).cast("long").alias("n_removed"),
        pick(F.lit(1), F.col("n_spans"), F.lit(0)).cast("long").alias("n_spans"),
        pick(F.sha2(F.lit(""), 256), F.col("kept_sha256"), F.col("whole")).alias("kept_sha256"),
        pick(F.array(F.lit(0)), F.col("starts"), empty).alias("starts"),
        pick(F.array(F.col("n_bytes").cast("int")), F.col("ends"), empty).alias("ends"),
    )


def op1_repeats(spark, sf_dir: str) -> DataFrame:
    """What every document loses, and the hash of what it keeps."""
    return find_repeats(S.table(spark, sf_dir, "documents")).drop("starts", "ends")
