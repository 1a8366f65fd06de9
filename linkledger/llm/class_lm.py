"""Language-model scores by a Brown class-based bigram model.

All training documents are counted. Every word seen twice or more belongs to one of CLASSES
classes, found by exchange clustering: the SEEDS most frequent words one after the other on
their bigrams, then all words at once, ROUNDS times: each moves to the class that raises the
likelihood of the class bigrams most, judged by how often each class stands before and after
it. The end is a class of its own; words seen once and words never seen share one class for
each kind of last character, so that the words seen once tell where new words stand. A
token's probability is

    P(class | class before) * P(word | class),

where class transitions are smoothed by the classes' own shares (Dirichlet, PRIOR), and
words by half a count. The text's score is the sum of its tokens' log10, the end included.

Counts and classes of up to FREQUENT words are broadcast, chosen by a least count, 2 or
more, so that ties fall out together. That is a bound on memory, not on the model: other
words seen twice or more get their classes by the same rule from a table, and each text
that has any gets theirs by a join. Counts of other words are joined by the word's hash.

Defined cases: null, empty and blank texts hold just the end; an empty table gives an
empty result; with nothing to learn from, N and V are 0 and every token gets what its
class shares of nothing leave; repeated rows are scored and counted each; rows without
an id are learned from and not held out; ties between classes go to the first; very long
texts are whole; other columns, whatever their names, are not read.
Memory: a slab of texts, or the longest, beside the broadcast tables of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from . import _spark as S

SEEDS, CLASSES, SWEEPS, ROUNDS = 1000, 64, 4, 2
FREQUENT = 1 << 18
#: Kinds of last character: letter, digit, other; each has a class for words seen once or never.
KINDS = 3
END = CLASSES
WIDTH = CLASSES + 1 + KINDS
#: Of a number below twice WIDTH.
SLOT = "u1" if 2 * WIDTH <= 256 else "<u2"
PRIOR = 30.0
WORDS = B.Words(B.SPACES, seed=10)
#: The end's hash; no word has a kind of 3.
END_HASH, END_KIND = 0, 3
_KIND = np.full(256, 2, np.uint8)
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 0
_KIND[48:58] = 1


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is 1 modulo 5; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def word_slabs(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(from row, to row, word hashes, kinds, first word of each text and one more)."""
    buf, off = B.text_bytes(column)
    for lo, hi in B.slabs(off):
        part, inner = buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        starts, ends, first = WORDS.find(part, inner)
        yield lo, hi, WORDS.hash(part, starts, ends), _KIND[part[ends - 1]] if len(ends) else np.zeros(0, np.uint8), first


def token_counts(texts: DataFrame) -> DataFrame:
    """(hash, kind, n) of every token of the texts, the end included."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.array([len(batch)], np.int64)
            for _, _, hashes, kinds, _ in word_slabs(batch.column(0)):
                own, at, n = np.unique(hashes, return_index=True, return_counts=True)
                yield pa.record_batch([pa.array(own.view(np.int64)), pa.array(kinds[at].astype(np.int32)), pa.array(n.astype(np.int64))], ["hash", "kind", "n"])
            yield pa.record_batch([pa.array([END_HASH], pa.int64()), pa.array([END_KIND], pa.int32()), pa.array(ends)], ["hash", "kind", "n"])

    return texts.mapInArrow(count, "hash long, kind int, n long").where("n > 0").groupBy("hash", "kind").agg(F.sum("n").alias("n"))


class Table:
    """The frequent words, sorted by hash, with counts and classes."""

    def __init__(self, hashes: np.ndarray, kinds: np.ndarray, counts: np.ndarray) -> None:
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]
        self.classes = (END + 1 + kinds[order]).astype(np.int16)
        self.top = np.lexsort((self.hashes, -self.counts))[:SEEDS]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Each hash's row, or -1."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        own, of = np.unique(hashes, return_inverse=True)
        at = np.searchsorted(self.hashes, own)
        at[at == len(self.hashes)] = 0
        return np.where(self.hashes[at] == own, at, -1)[of]

    def classes_of(self, rows: np.ndarray, hashes: np.ndarray, kinds: np.ndarray, more: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """The words' classes; `more` has hashes, ascending, and classes of words beyond the table."""
        out = END + 1 + kinds.astype(np.int64)
        if len(self.hashes):
            out = np.where(rows >= 0, self.classes[rows], out)
        if len(more[0]):
            at = np.searchsorted(more[0], hashes)
            at[at == len(more[0])] = 0
            out = np.where((rows < 0) & (more[0][at] == hashes), more[1][at], out)
        return out


MORE = "array<struct<hash:long,class:int>>"


def more_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, and classes of the words that the rows' lists hold."""
    words = column.drop_null().flatten()
    own, first = np.unique(words.field("hash").to_numpy(zero_copy_only=False).astype(np.int64).view(B.U64), return_index=True)
    return own, words.field("class").to_numpy(zero_copy_only=False).astype(np.int64)[first]


def with_ends(values: np.ndarray, first: np.ndarray, end: int) -> np.ndarray:
    """`end`, then each text's values and `end` after them."""
    return np.concatenate([[end], np.insert(values, first[1:], end)])


def bigram_counts(texts: DataFrame, known, width: int, number) -> DataFrame:
    """(pair, n) of texts (text, more): number(table, hashes, kinds, more) gives each token's code below width; pair is code before * width + code."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            more = more_words(batch.column(1))
            for _, _, hashes, kinds, first in word_slabs(batch.column(0)):
                codes = with_ends(number(known.value, hashes, kinds, more), first, width - 1 if number is _as_seed else END)
                own, n = np.unique(codes[:-1] * width + codes[1:], return_counts=True)
                yield pa.record_batch([pa.array(own.astype(np.int64)), pa.array(n.astype(np.int64))], ["pair", "n"])

    return texts.mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _as_seed(table: Table, hashes, kinds, more):
    """A seed's rank, SEEDS for other words; the end is one more."""
    ranks = np.full(len(table.hashes) + 1, SEEDS)
    ranks[table.top] = np.arange(len(table.top))
    return ranks[table.find(hashes)]


def _as_class(table: Table, hashes, kinds, more):
    return table.classes_of(table.find(hashes), hashes, kinds, more)


CONTEXTS = "bucket int, words binary, lengths binary, slots binary, counts binary, pair long, n long"


def context_counts(texts: DataFrame, known, buckets: int) -> DataFrame:
    """CONTEXTS: how often words stand before and after each class, packed; and, without bucket, the class bigrams (pair, n).

    Slot c is class c after the word, WIDTH + c is class c before it. A word's counts are in
    the bucket of its hash. Words of the table are counted, or, where `known` says so, all others.
    """
    beyond = known.value[1]
    slots_of = 2 * WIDTH
    names = [c.split()[0] for c in CONTEXTS.split(", ")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = known.value[0]
        held, size, joint = [], 0, np.zeros(WIDTH * WIDTH, np.int64)

        def packed() -> Iterator[pa.RecordBatch]:
            words, slots, counts = summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
            words = words if beyond else table.hashes[words.astype(np.int64)]
            bucket = (B.mix(words) % B.U64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            words, slots, counts, bucket = words[order], slots[order], counts[order], bucket[order]
            for b in np.unique(bucket).tolist():
                own = slice(np.searchsorted(bucket, b), np.searchsorted(bucket, b, "right"))
                new = np.flatnonzero(np.diff(words[own], prepend=~words[own][:1]))
                data = [words[own][new], np.diff(np.append(new, len(words[own]))).astype("<u2"), slots[own].astype(SLOT), counts[own].astype("<u4")]
                yield pa.record_batch([pa.array([b], pa.int32()), *(pa.array([zstandard.ZstdCompressor(level=1).compress(x.tobytes())], pa.binary()) for x in data), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())], names)

        for batch in batches:
            more = more_words(batch.column(1))
            for _, _, hashes, kinds, first in word_slabs(batch.column(0)):
                rows = table.find(hashes)
                chain = with_ends(table.classes_of(rows, hashes, kinds, more), first, END)
                joint += np.bincount(chain[:-1] * WIDTH + chain[1:], minlength=WIDTH * WIDTH)
                at = np.arange(len(hashes)) + np.repeat(np.arange(len(first) - 1), np.diff(first)) + 1
                own = np.flatnonzero((rows < 0) == beyond)
                slots = np.concatenate([chain[at[own] + 1], WIDTH + chain[at[own] - 1]])
                if beyond:
                    held.append(summed(np.tile(hashes[own], 2), slots, np.ones(len(slots), np.int64)))
                else:  # a word and a slot as one number
                    keys, n = np.unique(np.tile(rows[own], 2) * slots_of + slots, return_counts=True)
                    held.append(((keys // slots_of).astype(B.U64), keys % slots_of, n))
                size += len(held[-1][0])
                if size > 1 << 20:
                    yield from packed()
                    held, size = [], 0
        if size:
            yield from packed()
        pairs = np.flatnonzero(joint)
        yield pa.record_batch([*(pa.nulls(len(pairs), kind) for kind in (pa.int32(), *[pa.binary()] * 4)), pa.array(pairs), pa.array(joint[pairs])], names)

    return texts.mapInArrow(count, CONTEXTS)


def summed(words: np.ndarray, slots: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (word, slot), ascending, with the sums of their counts."""
    if not len(words):
        return words, slots, counts
    own, of = np.unique(words, return_inverse=True)
    keys = of * (2 * WIDTH) + slots
    order = np.argsort(keys)
    keys = keys[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return own[keys[new] // (2 * WIDTH)], keys[new] % (2 * WIDTH), np.add.reduceat(counts[order], new)


def best_classes(words: np.ndarray, slots: np.ndarray, counts: np.ndarray, current: np.ndarray, joint: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, class): for each word of sorted (word, slot) counts, the class that raises the likelihood most.

    current: the class of each word in joint, the class bigrams, its own counts included.
    """
    starts = np.flatnonzero(np.diff(words, prepend=~words[:1])) if len(words) else np.zeros(0, np.int64)
    f = lambda x: x * np.log(np.maximum(x, 1.0))
    now = np.repeat(current, np.diff(np.append(starts, len(words))))
    out = np.zeros(len(starts), np.int64)
    after = slots < WIDTH
    half = lambda keep: np.add.reduceat(np.where(keep, counts, 0), starts)
    totals = (half(after), half(~after)) if len(starts) else (out, out)
    for a in range(0, len(starts), 4096):
        own = slice(starts[a], starts[a + 4096] if a + 4096 < len(starts) else len(words))
        c, n = slots[own] % WIDTH, counts[own][:, None].astype(float)
        held = np.where(after[own][:, None], joint[:CLASSES, c].T, joint[c, :CLASSES])
        held = held - n * (now[own][:, None] == np.arange(CLASSES))
        gain = np.add.reduceat(f(held + n) - f(held), starts[a : a + 4096] - starts[a], axis=0)
        mine = current[a : a + 4096][:, None] == np.arange(CLASSES)
        for total, sums in ((totals[0], joint.sum(1)), (totals[1], joint.sum(0))):
            n = total[a : a + 4096][:, None].astype(float)
            left = sums[None, :CLASSES] - n * mine
            gain -= f(left + n) - f(left)
        out[a : a + 4096] = gain.argmax(1)
    return words[starts], out


def _moved(known, joint: np.ndarray):
    """(hash, class, n) of a bucket's words that were seen twice or more."""

    def unpacked(column: pa.ChunkedArray, kind: str) -> np.ndarray:
        tool = zstandard.ZstdDecompressor()
        return np.concatenate([np.frombuffer(tool.decompress(x.as_py()), kind) for x in column])

    def moved(rows: pa.Table) -> pa.Table:
        table = known.value[0]
        words = np.repeat(unpacked(rows["words"], "<u8"), unpacked(rows["lengths"], "<u2"))
        words, slots, counts = summed(words, unpacked(rows["slots"], SLOT).astype(np.int64), unpacked(rows["counts"], "<u4").astype(np.int64))
        starts = np.flatnonzero(np.diff(words, prepend=~words[:1]))
        n = np.add.reduceat(np.where(slots < WIDTH, counts, 0), starts)
        at = table.find(words[starts])
        current = table.classes[at].astype(np.int64) if len(table.hashes) else np.zeros(len(starts), np.int64)
        own, classes = best_classes(words, slots, counts, np.where(at >= 0, current, -1), joint)
        kept = n >= 2
        return pa.table({"hash": pa.array(own[kept].view(np.int64)), "class": pa.array(classes[kept].astype(np.int32)), "n": pa.array(n[kept])})

    def typed(rows):
        return moved(rows)

    typed.__annotations__ = {"rows": pa.Table, "return": pa.Table}
    return typed


def exchanged(texts: DataFrame, table: Table, beyond: bool, buckets: int) -> DataFrame:
    """(hash, class, n) of the table's words, or of all others seen twice or more, each in the class that fits it best."""
    known = texts.sparkSession.sparkContext.broadcast((table, beyond))
    contexts = S.written(context_counts(texts, known, buckets))
    joint = dense(contexts.where("bucket is null").groupBy("pair").agg(F.sum("n").alias("n")), WIDTH)
    packed = contexts.where("bucket is not null").select("bucket", "words", "lengths", "slots", "counts")
    return packed.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_moved(known, joint), "hash long, class int, n long")


def dense(pairs: DataFrame, width: int) -> np.ndarray:
    """The counts as a matrix of width squared; no more rows than that reach the driver."""
    rows = pairs.toArrow()
    out = np.zeros(width * width)
    out[rows["pair"].to_numpy()] = rows["n"].to_numpy()
    return out.reshape(width, width)


def exchange_clusters(bigrams: np.ndarray, words: int, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of each of the first `words` codes of a bigram matrix; other codes are classes of their own.

    The first words begin in classes of their own, all others in the last, and each in turn
    moves to the class that raises the bigram likelihood most, until none moves or `sweeps`
    are done.
    """
    width = len(bigrams)
    of = np.concatenate([np.minimum(np.arange(words), classes - 1), classes + np.arange(width - words)])
    size = classes + width - words
    joint = np.zeros((size, size))
    np.add.at(joint, (of[:, None], of[None, :]), bigrams)
    f = lambda x: x * np.log(np.maximum(x, 1.0))
    for _ in range(sweeps):
        moved = 0
        for w in range(words):
            own = bigrams[w, w]
            to, fro = np.bincount(of, bigrams[w], size), np.bincount(of, bigrams[:, w], size)
            g = of[w]
            to[g] -= own
            fro[g] -= own
            joint[g] -= to
            joint[:, g] -= fro
            joint[g, g] -= own
            rows, columns = f(joint + to) - f(joint), f(joint + fro[:, None]) - f(joint)
            d = np.diag(joint)
            gain = rows.sum(1) - np.diag(rows) + columns.sum(0) - np.diag(columns) + f(d + to + fro + own) - f(d)
            left, right = joint.sum(1), joint.sum(0)
            gain -= f(left + to.sum() + own) - f(left) + f(right + fro.sum() + own) - f(right)
            k = int(gain[:classes].argmax())
            moved += k != g
            joint[k] += to
            joint[:, k] += fro
            joint[k, k] += own
            of[w] = k
        if not moved:
            break
    return of[:words]


class Model:
    """Logarithms by class and frequent word."""

    def __init__(self, table: Table, n: int, v: int, ends: int, sums: np.ndarray, types: np.ndarray, pairs: np.ndarray) -> None:
        """sums and types: the training tokens and distinct words of each class."""
        self.table, self.n, self.v, self.ends = table, n, v, ends
        unseen = np.zeros(WIDTH)
        unseen[END + 1 :] = 1
        mass = sums + 0.5 * (types + unseen)
        share = mass / max(mass.sum(), 0.5)
        follow = (pairs + PRIOR * share) / (pairs.sum(1, keepdims=True) + PRIOR)
        with np.errstate(divide="ignore"):
            self.follow = np.log10(np.maximum(follow, 1e-300))
            self.mass = np.log10(np.maximum(mass, 0.5))
        self.half = np.log10(table.counts + 0.5)
        self.whole = float(np.log10(n + 0.5 * (v + 1)))


def with_more(texts: DataFrame, table: Table, words: DataFrame | None) -> DataFrame:
    """texts with `more` (MORE): the classes of its words that words (hash, class) has and the table hasn't."""
    if words is None:
        return texts.withColumn("more", F.lit(None).cast(MORE))
    known = texts.sparkSession.sparkContext.broadcast(table)

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, hashes, _, first in word_slabs(batch.column(1)):
                own = np.flatnonzero(known.value.find(hashes) < 0)
                of = np.repeat(batch.column(0).to_numpy()[lo:hi], np.diff(first))
                pairs = np.unique(np.stack([of[own], hashes[own].view(np.int64)]), axis=1)
                yield pa.record_batch([pa.array(pairs[0]), pa.array(pairs[1])], ["key", "hash"])

    key = F.xxhash64("text")  # texts of one key get what any of them has
    found = texts.select(key.alias("key"), "text").mapInArrow(rest, "key long, hash long").join(words.select("hash", "class"), "hash")
    lists = found.groupBy("key").agg(F.collect_set(F.struct("hash", "class")).alias("more"))  # copies of a text add nothing to its set
    return texts.withColumn("key", key).join(lists, "key", "left").drop("key")


def learn(rows: DataFrame) -> tuple[Model, DataFrame, int, DataFrame]:
    """The model of rows (text, learned, ...) that are learned, all token counts, the least count of broadcast words, and rows with `more`."""
    spark = rows.sparkSession
    texts = rows.where("learned").select("text")
    counts = S.cut(token_counts(texts))
    words = counts.where(F.col("kind") != END_KIND)
    # the least count that FREQUENT words at most have, from how many words have each count
    by_count = words.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n"))
    least, held = 1 << 62, 0
    for row in by_count.toLocalIterator():
        held += row["words"]
        if held > FREQUENT or row["n"] < 2:
            break
        least = row["n"]
    top = words.where(F.col("n") >= least).toArrow()
    table = Table(top["hash"].to_numpy().astype(np.int64).view(B.U64), top["kind"].to_numpy().astype(np.int64), top["n"].to_numpy().astype(np.int64))
    texts = with_more(texts, table, None)
    pairs = dense(bigram_counts(texts, spark.sparkContext.broadcast(table), SEEDS + 2, _as_seed), SEEDS + 2)
    table.classes[table.top] = exchange_clusters(pairs, SEEDS, CLASSES)[: len(table.top)]
    total = texts.select(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    buckets = max(32, total >> 24)
    for _ in range(ROUNDS if len(table.hashes) else 0):
        moved = exchanged(texts, table, False, buckets).select("hash", "class").toArrow()  # FREQUENT rows at most
        table.classes[table.find(moved["hash"].to_numpy().astype(np.int64).view(B.U64))] = moved["class"].to_numpy()
    others = None
    if not words.where((F.col("n") >= 2) & (F.col("n") < least)).isEmpty():
        others = S.cut(exchanged(texts, table, True, buckets))
    rows = with_more(rows, table, others)
    if others is not None:
        rows = S.written(rows)
    pairs = dense(bigram_counts(rows.where("learned").select("text", "more"), spark.sparkContext.broadcast(table), WIDTH, _as_class), WIDTH)
    sums, types = np.zeros(WIDTH), np.zeros(WIDTH)
    np.add.at(sums, table.classes, table.counts)
    np.add.at(types, table.classes, 1)
    for row in others.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect() if others is not None else []:  # a row for each class
        sums[row["class"]] += row["n"]
        types[row["class"]] += row["v"]
    ends = 0
    for row in counts.where((F.col("n") < 2) | (F.col("kind") == END_KIND)).groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():  # a row for each kind
        c = END if row["kind"] == END_KIND else END + 1 + row["kind"]
        sums[c] += row["n"]
        types[c] += row["v"]
        ends += row["n"] * (row["kind"] == END_KIND)
    return Model(table, int(sums.sum()), int(types.sum()), ends, sums, types, pairs), counts, least, rows


def _score(known):
    """The UDF: what the broadcast tables tell of each text, and the hashes of its other words, repeats included."""

    def score(texts: pa.Array, lists: pa.Array) -> pa.Array:
        model, out, more = known.value, [], more_words(lists)
        table = model.table
        for lo, hi, hashes, kinds, first in word_slabs(texts):
            m, n = hi - lo, np.diff(first)
            rows = table.find(hashes)
            classes = table.classes_of(rows, hashes, kinds, more)
            of = np.repeat(np.arange(m), n)
            half = np.where(rows >= 0, model.half[rows], 0.0) if len(table.hashes) else np.zeros(len(rows))
            known_half = np.bincount(of, half, m)[:m] + np.log10(model.ends + 0.5)
            chain = with_ends(classes, first, END)
            step = model.follow[chain[:-1], chain[1:]] - model.mass[chain[1:]]
            sums = np.bincount(np.repeat(np.arange(m), n + 1), step, m)[:m]
            known_words = np.bincount(of, rows >= 0, m)[:m].astype(np.int64) + (model.ends > 0)
            rare = rows < 0
            offsets = np.concatenate([[0], np.cumsum(rare)])[first]
            rest = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(hashes[rare].view(np.int64)))
            out.append(pa.StructArray.from_arrays([pa.array(n + 1), pa.array(known_words), pa.array(known_half), pa.array(sums), rest], ["n_tokens", "n_known", "half", "classes", "rest"]))
        kind = pa.struct([("n_tokens", pa.int64()), ("n_known", pa.int64()), ("half", pa.float64()), ("classes", pa.float64()), ("rest", pa.list_(pa.int64()))])
        return pa.concat_arrays(out).cast(kind) if out else pa.array([], kind)

    def typed(texts, lists):
        return score(texts, lists)

    typed.__annotations__ = {"texts": pa.Array, "lists": pa.Array, "return": pa.Array}
    return F.arrow_udf(typed, "struct<n_tokens:long,n_known:long,half:double,classes:double,rest:array<long>>").asNondeterministic()


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), (~held_out(F.col(doc_id))).alias("learned"))
    model, counts, least, rows = learn(rows)
    known = docs.sparkSession.sparkContext.broadcast(model)
    scored = rows.select("doc_id", F.monotonically_increasing_id().alias("row"), _score(known)(F.col("text"), F.col("more")).alias("s"))
    scored = S.written(scored.select("doc_id", "row", "s.*"))
    rest = scored.select("row", F.explode("rest").alias("hash"))
    rare = counts.where((F.col("n") < least) & (F.col("kind") != END_KIND)).select("hash", "n")
    found = rest.join(rare, "hash", "left").groupBy("row").agg(F.count("n").alias("more"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rare"))
    out = scored.drop("rest").join(found, "row", "left")
    half = F.col("half") + F.coalesce("rare", F.lit(0.0))
    return out.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(model.n).cast("long").alias("train_tokens"),
        (half - F.col("n_tokens") * model.whole).alias("base_score"),
        (half + F.col("classes")).alias("score"),
    )


def op10_class_lm(spark, sf_dir: str) -> DataFrame:
    """Every document's unigram base score and class-based score."""
    return score(S.table(spark, sf_dir, "documents"))
