"""Token ids of documents in binary files with a shared zstandard dictionary.

Documents are put in ascending order of doc_id by ranges. Each task encodes its range
with the `tokenizers` library and packs blocks: every document's ids are one zstandard
frame of its own, beside an index of doc_ids and of the frames' offsets, and the SHA-256
of the dictionary that all frames need. Blocks are rows of Parquet files, so any store
that Spark writes to will do, and a lost task leaves nothing behind. A short document is
read by its block's range of doc_ids, its offset and the dictionary, without the rest.

The dictionary is trained on serialized id arrays of about SAMPLE documents, of each
WHOLE ids at most; a table with too few gets frames without dictionary.

Texts are cut where the byte-level pre-tokenizer always cuts, each distinct piece of a
slab is encoded once, and a worker remembers up to REMEMBER of them; the ids are those of
whole texts, special strings in a text included.

Defined cases: null is an empty text: only the end id; null doc_ids come first; rows with
equal doc_ids are ordered by the hash of their texts; empty tables give empty files; extra
columns are not read. Memory: one slab, or one document, and one block.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _bytes as B
from . import _spark as S

END = 0
#: Documents to train the dictionary on, about, ids of each at most, and the dictionary's bytes.
SAMPLE, WHOLE, DICTIONARY = 2000, 8192, 64 << 10
#: Bytes of frames at which a block is closed.
BLOCK = 4 << 20
REMEMBER = 1 << 20
LEVEL = 1
BLOCKS = "part int, block int, first_doc_id long, last_doc_id long, n_ids long, dictionary_sha256 string, doc_ids array<long>, offsets array<long>, frames binary"
_PIECES = B.Words(b"", seed=9, fold=False)


def cuts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where a text can be cut without changing its ids, starts of texts included.

    Before a space or newline, and after a newline, that stands alone between other
    characters; characters next to it that might be Unicode spaces rule a place out.
    """
    n = len(buf)
    place = np.zeros(n + 1, bool)
    place[off] = True  # first characters of texts, and last, have no neighbour in their text
    if n < 3:
        return np.flatnonzero(place[:-1])
    white = buf <= 0x20
    lead = np.zeros(256, bool)
    lead[[0xC2, 0xE1, 0xE2, 0xE3]] = True
    before = ~white[:-2] & ~(((buf[:-2] == 0x85) | (buf[:-2] == 0xA0)) & lead[np.concatenate([buf[:1], buf[:-3]])])
    third = np.zeros(n - 2, bool)
    third[2:] = lead[buf[:-4]] & (buf[:-4] != 0xC2)
    alone = before & ~third & ~white[2:] & ~lead[buf[2:]]
    at = np.flatnonzero(alone & ((buf[1:-1] == 0x20) | (buf[1:-1] == 0x0A))) + 1
    at = at[~place[at] & ~place[at + 1]]
    place[at] = place[at[buf[at] == 0x0A] + 1] = True
    return np.flatnonzero(place[:-1])


class Encoder:
    """Ids of many texts at once; pieces that came before are remembered."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        added = {i: len(t.content.encode()) for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.length = np.array([added.get(i, len(self.tokenizer.id_to_token(i) or "")) for i in range(size)], np.int64)
        self.forget()

    def forget(self) -> None:
        self.keys, self.at, self.count, self.ids = np.zeros(0, B.U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _whole(self, texts: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def _learn(self, buf: np.ndarray, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray, joinable: np.ndarray) -> None:
        """Encodes pieces; joinable ones, a space and what follows up to the next, as one text."""
        ids, counts, order = [], [], []
        rows = np.flatnonzero(joinable)
        for part in np.array_split(rows, max(1, int((ends - starts)[rows].sum()) >> 18)) if len(rows) else []:
            sizes = (ends - starts)[part]
            to = np.cumsum(sizes)
            index = np.arange(to[-1]) + np.repeat(starts[part] - (to - sizes), sizes)
            got = np.array(self._whole([buf[index].tobytes()])[0], np.uint32)
            reach = np.cumsum(self.length[got])
            last = np.searchsorted(reach, to)
            if last[-1] < len(reach) and (reach[last] == to).all():
                ids.append(got)
                counts.append(np.diff(last + 1, prepend=0))
                order.append(part)
            else:  # the pre-tokenizer cuts in another way than this file expects
                joinable[part] = False
        rows = np.flatnonzero(~joinable)
        if len(rows):
            each = self._whole([buf[a:b].tobytes() for a, b in zip(starts[rows].tolist(), ends[rows].tolist(), strict=True)])
            ids.append(np.array([i for one in each for i in one], np.uint32))
            counts.append(np.array([len(one) for one in each], np.int64))
            order.append(rows)
        counts, order = np.concatenate(counts), np.concatenate(order)
        if len(self.keys) + len(keys) > REMEMBER:
            self.forget()
        at = len(self.ids) + np.cumsum(counts) - counts
        all_keys = np.concatenate([self.keys, keys[order]])
        by = np.argsort(all_keys, kind="stable")
        self.keys, self.at, self.count = all_keys[by], np.concatenate([self.at, at])[by], np.concatenate([self.count, counts])[by]
        self.ids = np.concatenate([self.ids, *ids])

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each has."""
        starts = cuts(buf, off)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(off) - 1, np.int64)
        ends = np.append(starts[1:], len(buf))
        keys, first, of = np.unique(_PIECES.hash(buf, starts, ends), return_index=True, return_inverse=True)
        where = np.searchsorted(self.keys, keys)
        where[where == len(self.keys)] = 0
        new = self.keys[where] != keys if len(self.keys) else np.ones(len(keys), bool)
        if new.any():
            if len(self.keys) + int(new.sum()) > REMEMBER:
                self.forget()
                new = np.ones(len(keys), bool)
            at = first[new]
            edge = np.zeros(len(buf) + 1, bool)
            edge[off] = True
            self._learn(buf, keys[new], starts[at], ends[at], (buf[starts[at]] == 0x20) & ~edge[starts[at]] & ~edge[ends[at]])
            where = np.searchsorted(self.keys, keys)
        at, count = self.at[where][of], self.count[where][of]
        total = np.cumsum(count)
        ids = self.ids[np.arange(total[-1]) + np.repeat(at - (total - count), count)]
        reach = np.concatenate([[0], total])[np.searchsorted(starts, off)]
        return ids, np.diff(reach)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def id_arrays(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(doc_ids, ids, how many each document has), the end ids included, slab by slab."""
    for batch in batches:
        buf, off = B.text_bytes(batch.column(1))
        doc_ids = batch.column(0).to_pylist()
        for lo, hi in B.slabs(off, 2 << 20):
            ids, n = encoder(path).encode(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            yield doc_ids[lo:hi], np.insert(ids, np.cumsum(n), END), n + 1


def serialize(ids: np.ndarray) -> bytes:
    """The width of an id in bytes, 2 or 4, and the ids as little-endian numbers."""
    wide = len(ids) and ids.max() > 0xFFFF
    return (b"\4" + ids.astype("<u4").tobytes()) if wide else (b"\2" + ids.astype("<u2").tobytes())


def deserialize(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u4" if data[0] == 4 else "<u2", offset=1).astype("<u4")


def train_dictionary(docs: DataFrame, path: str, sample: int = SAMPLE) -> bytes:
    """The shared dictionary, from about `sample` documents chosen by a hash of their ids."""
    n = docs.count()
    chosen = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("dictionary")), F.lit(1 << 30)) < F.lit(int(min(1.0, sample / max(1, n)) * (1 << 30)))).limit(4 * sample)

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, n in id_arrays(batches, path):
            yield pa.record_batch([pa.array([serialize(x[:WHOLE]) for x in np.split(ids, np.cumsum(n)[:-1])], pa.binary())], ["ids"])

    samples = [bytes(r[0]) for r in chosen.mapInArrow(arrays, "ids binary").collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY, sorted(samples)).as_bytes()
    except zstandard.ZstdError:
        return b""


def write(docs: DataFrame, to: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> None:
    """Writes blocks to the folder `to`/blocks and the dictionary to `to`/dictionary."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    dictionary = train_dictionary(docs, tokenizer)
    digest = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(digest, bytearray(dictionary))], "sha256 string, data binary").coalesce(1).write.parquet(f"{to}/dictionary")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        part, block = TaskContext.get().partitionId(), 0
        owners, offsets, frames, total = [], [0], [], 0

        def closed() -> pa.RecordBatch:
            known = [i for i in owners if i is not None]
            columns = [[part], [block], [min(known, default=None)], [max(known, default=None)], [total], [digest], [owners], [offsets], [b"".join(frames)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in BLOCKS.split(", ")])

        for doc_ids, ids, n in id_arrays(batches, tokenizer):
            for i, one in zip(doc_ids, np.split(ids, np.cumsum(n)[:-1]), strict=True):
                frames.append(pack.compress(serialize(one)))
                owners.append(i)
                offsets.append(offsets[-1] + len(frames[-1]))
                total += len(one)
                if offsets[-1] >= BLOCK:
                    yield closed()
                    block += 1
                    owners, offsets, frames, total = [], [0], [], 0
        if owners:
            yield closed()

    # equal rows differ by their place in the input, so that a repeated row doesn't stay in one range
    order = ["doc_id", "_hash", "_place"]
    placed = docs.withColumn("_hash", F.xxhash64("text")).withColumn("_place", F.monotonically_increasing_id())
    placed = placed.repartitionByRange(S.bucket_count(docs, "text"), *order).sortWithinPartitions(*order)
    placed.select("doc_id", "text").mapInArrow(blocks, BLOCKS).write.parquet(f"{to}/blocks")


def dictionary_of(spark: SparkSession, path: str) -> tuple[str, bytes]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    return row["sha256"], bytes(row["data"])


def _unpacker(digest: str, dictionary: bytes):
    def unpack(frame: memoryview, wanted: str) -> np.ndarray:
        if wanted != digest:
            raise ValueError(f"the frame needs dictionary {wanted}, this one is {digest}")
        tool = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        return deserialize(tool.decompress(frame))

    return unpack


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens and ids_crc32, from the files."""
    digest, dictionary = dictionary_of(spark, path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        for batch in batches:
            for k in range(len(batch)):
                row = {name: batch.column(i)[k] for i, name in enumerate(batch.schema.names)}
                if row["dictionary_sha256"].as_py() != digest:
                    raise ValueError(f"a block needs another dictionary than {digest}")
                offsets, frames = row["offsets"].as_py(), memoryview(row["frames"].as_buffer())
                n, crc = [], []
                for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                    ids = deserialize(tool.decompress(frames[a:b]))
                    n.append(len(ids))
                    crc.append(zlib.crc32(ids.tobytes()))
                m = len(n)
                yield pa.record_batch([pa.array([row["part"].as_py()] * m, pa.int32()), pa.array([row["block"].as_py()] * m, pa.int32()), pa.array(row["doc_ids"].as_py(), pa.int64()), pa.array(np.cumsum(n) - n, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["part", "block", "doc_id", "inside", "n_tokens", "ids_crc32"])

    blocks = spark.read.parquet(f"{path}/blocks")
    starts = S.running_total(blocks.select("part", "block", "n_ids"), ["part", "block"], "n_ids", "before").select("part", "block", "before")
    rows = blocks.select("part", "block", "dictionary_sha256", "doc_ids", "offsets", "frames").mapInArrow(decode, "part int, block int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["part", "block"]).select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[np.ndarray]:
    """The ids of the rows with one doc_id; only their frames are decompressed."""
    unpack = _unpacker(*dictionary_of(spark, path))
    blocks = spark.read.parquet(f"{path}/blocks").where((F.col("first_doc_id") <= doc_id) & (F.col("last_doc_id") >= doc_id))
    at = blocks.select("dictionary_sha256", "frames", "offsets", F.posexplode("doc_ids").alias("k", "doc_id")).where(F.col("doc_id") == doc_id)
    rows = at.select("dictionary_sha256", F.expr("substring(frames, cast(get(offsets, k) as int) + 1, cast(get(offsets, k + 1) - get(offsets, k) as int))").alias("frame")).collect()
    return [unpack(memoryview(bytes(r["frame"])), r["dictionary_sha256"]) for r in rows]


def op9_token_files(spark, sf_dir: str) -> DataFrame:
    """Writes every document's ids to the shared folder and reads the files back."""
    import public_tokenizers

    to = f"{S.checkpoint_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write(S.table(spark, sf_dir, "documents"), to, public_tokenizers.path("byte_bpe_50k.json"))
    return read(spark, to)
