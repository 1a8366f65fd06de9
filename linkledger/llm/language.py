"""Language identification by cross-parsing entropy.

Of each language, a bounded sample of labelled text becomes a suffix automaton. A text is
parsed into phrases, each the longest match with something in the language's sample; a
language's cost is its phrases times the bits that name a place in its sample, and the
least cost wins, ties by the language's code point order. The score is the margin,
(second - least) / second; 1 where only one language is known.

Letters are folded to 60 symbols (a-z, and bytes of other letters by their lower five
bits); everything else separates. Whole texts are parsed. So that a long text doesn't hold
up the others, its segments of SEGMENT bytes are first read at once, each from the root;
then each segment is read again from where its predecessor really ended, up to the place
where both readings agree, until none changes: the phrases are those of one reading from
the start of the text to its end.

Defined cases: null texts and texts without a letter are `und` with score 0, and so is
every text where nothing is learned, or the table is empty; rows without a language, an id
or a text don't teach; repeated ids teach once; very long texts are parsed whole; extra
columns, whatever their names, pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from . import _spark as S

#: Documents of each language to learn from, about; bytes of each, from a place that a hash chooses; bytes of all languages
#: together (with more languages each excerpt is shorter); and labels that are learned, the most frequent ones.
SAMPLE, EXCERPT, LEARNED, LABELS = 200, 320, 512 << 10, 1000
SEGMENT = 256
SYMBOLS = 64
UNKNOWN = "und"
MISS = np.uint32(1 << 31)
_FOLD = np.zeros(256, np.uint8)
_FOLD[97:123] = _FOLD[65:91] = np.arange(1, 27)
_FOLD[128:] = 27 + (np.arange(128, 256) & 31)


def automaton(symbols: np.ndarray) -> np.ndarray:
    """The suffix automaton of a text: next states by state and symbol, 0 where there is none; state 0 is the root."""
    link, length, after = [-1], [0], [{}]
    last = 0
    for c in symbols.tolist():
        state = len(after)
        after.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in after[p]:
            after[p][c] = state
            p = link[p]
        if p >= 0:
            q = after[p][c]
            if length[p] + 1 == length[q]:
                link[state] = q
            else:
                clone = len(after)
                after.append(dict(after[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and after[p].get(c) == q:
                    after[p][c] = clone
                    p = link[p]
                link[q] = link[state] = clone
        last = state
    table = np.zeros((len(after), SYMBOLS), np.uint32)
    for s, edges in enumerate(after):
        for c, to in edges.items():
            table[s, c] = to
    return table


class Model:
    """The automata of all languages in one table; an entry holds the next row's place, and MISS where a phrase ends before the symbol."""

    def __init__(self, texts: dict[str, bytes]) -> None:
        self.languages = sorted(texts, key=lambda x: x.encode())
        parts, self.roots, self.bits, base = [], [], [], 0
        for name in self.languages:
            symbols = _FOLD[np.frombuffer(texts[name], np.uint8)]
            table = automaton(symbols)
            miss = table == 0
            table[miss] = np.broadcast_to(table[0], table.shape)[miss]
            parts.append(((table + np.uint32(base)) * np.uint32(SYMBOLS)) | np.where(miss, MISS, np.uint32(0)))
            self.roots.append(base * SYMBOLS)
            self.bits.append(np.log2(len(symbols) + 2))
            base += len(table)
        self.table = np.concatenate(parts).ravel() if parts else np.zeros(0, np.uint32)

    def phrases(self, symbols: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Phrases by language and text."""
        sizes = np.diff(off)
        pieces = -(-sizes // SEGMENT)
        of = np.repeat(np.arange(len(sizes)), pieces)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = off[:-1][of] + nth * SEGMENT
        length = np.minimum(SEGMENT, off[1:][of] - begin)
        order = np.argsort(-length, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        before = np.where(nth[order] > 0, place[np.maximum(order - 1, 0)], -1)
        begin, length, of = begin[order], length[order], of[order]
        alive = np.searchsorted(-length, -np.arange(1, SEGMENT + 1), side="right")
        roots = np.repeat(np.array(self.roots, np.uint32)[:, None], len(order), axis=1)
        read = np.zeros((SEGMENT, *roots.shape), np.uint32)
        end, begun = roots.copy(), roots
        for t in range(SEGMENT):
            k = int(alive[t])
            if not k:
                break
            step = self.table.take(end[:, :k] + symbols[begin[:k] + t])
            read[t, :, :k] = step
            np.bitwise_and(step, ~MISS, out=end[:, :k])
        while True:
            start = np.where(before >= 0, end[:, before], roots)
            lang, row = np.nonzero(start != begun)
            if not len(row):
                break
            state, begun = start[lang, row], start
            for t in range(SEGMENT):
                over = length[row] <= t
                if over.any():
                    end[lang[over], row[over]] = state[over]
                    lang, row, state = lang[~over], row[~over], state[~over]
                step = self.table.take(state + symbols[begin[row] + t])
                apart = ((step ^ read[t, lang, row]) & ~MISS) != 0
                read[t, lang, row] = step
                lang, row, state = lang[apart], row[apart], (step & ~MISS)[apart]
                if not len(row):
                    break
            end[lang, row] = state
        count = (read >> np.uint32(31)).sum(0)
        return np.stack([np.bincount(of, weights=one, minlength=len(sizes))[: len(sizes)] for one in count]).astype(np.int64) + (sizes > 0)

    def predict(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of each text's language, and its score."""
        cost = self.phrases(_FOLD[buf], off) * np.array(self.bits)[:, None]
        best = cost.argmin(0)
        if len(cost) == 1:
            return best, np.ones(len(best))
        two = np.partition(cost, 1, axis=0)[:2]
        return best, np.where(two[1] > 0, (two[1] - two[0]) / np.maximum(two[1], 1e-9), 0.0)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is 0 modulo 5; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> dict[str, bytes]:
    """What to learn each language from: excerpts of EXCERPT bytes of about `sample` of its labelled documents.

    The driver holds about `sample` excerpts of each of LABELS languages at most, LEARNED bytes in all.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("doc_id is not null and text is not null and lang is not null")
    counted = rows.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")).orderBy(F.desc("n"), "lang").limit(LABELS)
    n = {r["lang"]: r["n"] for r in counted.collect()}
    if not n:
        return {}
    size = max(1, min(EXCERPT, LEARNED // (len(n) * sample)))
    share = F.element_at(F.create_map(*(F.lit(x) for k, v in n.items() for x in (k, min(1.0, sample / v)))), F.col("lang"))
    place = F.pmod(F.xxhash64("doc_id", F.lit("place")), F.greatest(F.lit(1), F.length("text") - size)) + 1
    chosen = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30)) < share * (1 << 30))
    excerpts = chosen.select("lang", "doc_id", F.col("text").substr(place.cast("int"), F.lit(size)).alias("text")).groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    texts: dict[str, list[bytes]] = {}
    for r in excerpts.orderBy("lang", F.xxhash64("doc_id", F.lit("order"))).toLocalIterator():
        texts.setdefault(r["lang"], []).append(r["text"].encode()[:size])
    return {k: b" ".join(v) for k, v in texts.items() if any(v)}


_MODELS: dict[tuple, Model] = {}


def model_of(texts: dict[str, bytes]) -> Model:
    """The automata of the texts, built once by each worker; they take some hundred times the room of the texts."""
    key = tuple(sorted(texts.items()))
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Model(texts)
    return _MODELS[key]


def identify(docs: DataFrame, learned: dict[str, bytes], result: str, text: str = "text") -> DataFrame:
    """docs with `result`: struct<lang, score>, by what learn() gave."""
    if not learned:
        return docs.withColumn(result, F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score")))
    known = docs.sparkSession.sparkContext.broadcast(learned)

    def predict(texts: pa.Array) -> pa.Array:
        model = model_of(known.value)
        buf, off = B.text_bytes(texts)
        langs, scores = [], []
        for lo, hi in B.slabs(off):
            best, score = model.predict(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            langs += [model.languages[k] for k in best.tolist()]
            scores += score.tolist()
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    def typed(texts):
        return predict(texts)

    typed.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    found = F.arrow_udf(typed, "struct<lang:string,score:double>")(F.col(text))
    none = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"))
    return docs.withColumn(result, F.when(F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)), found).otherwise(none))


def known_documents(docs: DataFrame) -> DataFrame:
    """docs without those of unknown language; all their columns. Learns from all labelled rows of docs that aren't held out."""
    result = S.free_name(docs, "_language")
    learned = learn(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs, learned, result).where(F.col(result)["lang"] != UNKNOWN).drop(result)


def op4_language(spark, sf_dir: str) -> DataFrame:
    """Every document's language, learned from the documents that aren't held out."""
    docs = S.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learned = learn(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs.select("doc_id", "text"), learned, "found").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))
