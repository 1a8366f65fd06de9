"""How filters of documents interact: what each removes in every order in which they can be applied.

A document fails some of the FILTERS, a mask of five bits. Which step of an order removes
it follows from the mask alone, so a table of 32 masks by 120 orders is computed once.
Tasks look their documents' masks up in it and count removals by part, order and step, all
of them and those of good and of toxic documents, into arrays; the tasks' arrays are summed
by part and place. All other counts follow: what a step finds failing but gone before is
the filter's failures less its removals there.

Failures: A: under 200 words (maximal `[^\\x20\\x09-\\x0D]+`, case-sensitive); B: under half
as many distinct words as words; C: more than one character in fifty is a capital A-Z;
D: the text holds one of #$%&*|; E: a row with a smaller id anywhere in the table has an
identical text. Texts are compared by two independent 64-bit hashes and their lengths.

Defined cases: a null text is an empty one, and a null part an empty text; rows without id
neither make a copy of another row nor are one; rows with equal ids and texts are not each
other's copies; repeated rows count each; a document is good (toxic) if any label row of its
id says so, and neither without label; an empty table gives an empty result; very long
texts are whole; other columns, whatever their names, are not read. Copies of one text are
pre-aggregated before the shuffle that finds the first of them; the join that brings it back
to them may be split by adaptive execution, as copies can be a third of all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _spark as S
from .secrets import let

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS)
SPACE = r"[\x20\x09-\x0D]+"
#: Parts whose arrays a task holds at once.
HELD = 512
#: Places of a part's array: removals of all, of good and of toxic documents by order and step; failures, and failures of nothing else, by filter; documents.
REMOVED = len(ORDERS) * STEPS
FAILS, ALONE, ALL = 3 * REMOVED, 3 * REMOVED + STEPS, 3 * REMOVED + 2 * STEPS
PLACES = ALL + 1


def steps_table() -> np.ndarray:
    """The step (from 0) of each order that removes a document with each mask, STEPS if none does; bit k of a mask is FILTERS[k]."""
    masks = np.arange(1 << STEPS)
    out = np.full((len(masks), len(ORDERS)), STEPS, np.int64)
    for k, order in enumerate(ORDERS):
        for step in range(STEPS - 1, -1, -1):
            out[(masks >> FILTERS.index(order[step])) & 1 == 1, k] = step
    return out


def failures(text: Column) -> Column:
    """The mask of the filters A to D that a text fails."""

    def of(words: Column) -> Column:
        n = F.size(words)
        return F.when(n < 200, 1).otherwise(0) + F.when(100 * F.size(F.array_distinct(words)) < 50 * n, 2).otherwise(0)

    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    words = F.array_remove(F.split(text, SPACE), "")
    return let(words, of) + F.when(100 * capitals > 2 * F.length(text), 4).otherwise(0) + F.when(text.rlike(r"[#$%&*|]"), 8).otherwise(0)


def masks(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(doc_id, part, mask, good, toxic) of each row of docs."""
    body = F.coalesce(F.col(text), F.lit(""))
    kind = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), body.alias("text"))
    # 16 bytes of the text's hashes and its length stand for the text from here on
    rows = S.written(kind.select("doc_id", "part", failures(F.col("text")).alias("mask"), F.xxhash64("text").alias("_h"), F.xxhash64(F.lit(77), F.col("text")).alias("_g"), F.length("text").alias("_n")))
    key = ["_h", "_g", "_n"]
    # cut, so that both sides of the join are shuffled for it: only such partitions are split by adaptive execution
    first = S.cut(rows.groupBy(*key).agg(F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last")).where("_first < _last").drop("_last"))
    marked = rows.join(first, key, "left").select("doc_id", "part", (F.col("mask") + F.when(F.col("doc_id") > F.col("_first"), 16).otherwise(0)).alias("mask"))
    says = labels.select(F.col("doc_id").alias("_of"), F.col("quality") == 1, F.col("toxic") == 1).toDF("_of", "_good", "_toxic").where("_of is not null")
    says = says.groupBy("_of").agg(F.max("_good").alias("_good"), F.max("_toxic").alias("_toxic"))
    return marked.join(says, F.col("doc_id") == F.col("_of"), "left").select("doc_id", "part", "mask", F.coalesce("_good", F.lit(False)).alias("good"), F.coalesce("_toxic", F.lit(False)).alias("toxic"))


def counts(rows: DataFrame) -> DataFrame:
    """(part, counts): of masks(), each part's array of PLACES numbers."""
    table = steps_table()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        orders = np.arange(len(ORDERS)) * (STEPS + 1)
        own = np.array([mask.bit_count() == 1 for mask in range(1 << STEPS)])

        def out() -> pa.RecordBatch:
            parts = pa.array(held, pa.string())
            arrays = pa.ListArray.from_arrays(pa.array(np.arange(len(held) + 1) * PLACES, pa.int32()), pa.array(np.concatenate(list(held.values()))))
            held.clear()
            return pa.record_batch([parts, arrays], ["part", "counts"])

        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            names, of = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            mask, good, toxic = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3))
            place = (of[:, None] * len(ORDERS) * (STEPS + 1) + orders + table[mask]).ravel()
            room = len(names) * len(ORDERS) * (STEPS + 1)
            found = [np.bincount(place, None if w is None else np.repeat(w.astype(np.float64), len(ORDERS)), room).reshape(len(names), len(ORDERS), STEPS + 1)[:, :, :STEPS].reshape(len(names), -1) for w in (None, good, toxic)]
            fails = [np.bincount(of[hit], minlength=len(names)) for only in (False, True) for k in range(STEPS) for hit in [((mask >> k) & 1 == 1) & (own[mask] if only else True)]]
            rows = np.concatenate([*found, np.array(fails).T, np.bincount(of, minlength=len(names))[:, None]], axis=1).astype(np.int64)
            for name, row in zip(names, rows, strict=True):
                held[name] = held[name] + row if name in held else row
                if len(held) == HELD:
                    yield out()
        if held:
            yield out()

    partial = rows.select("part", "mask", "good", "toxic").mapInArrow(count, "part string, counts array<long>")
    summed = partial.select("part", F.posexplode("counts").alias("at", "n")).groupBy("part", "at").agg(F.sum("n").alias("n"))
    return summed.groupBy("part").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "n"))), lambda x: x["n"]).alias("counts"))  # PLACES rows for each part


def audit(rows: DataFrame) -> DataFrame:
    """Of masks(), a row for each part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley."""
    total = lambda places: F.aggregate(F.array(*map(F.lit, places)), F.lit(0).cast("long"), lambda a, k: a + F.get("counts", k))
    shares = F.array(*(total([k * STEPS + order.index(f) for k, order in enumerate(ORDERS)]) for f in FILTERS))
    each = counts(rows).select("part", "counts", shares.alias("shares")).select("*", F.posexplode(F.array(*map(F.lit, ORDERS))).alias("nth", "filter_order"))
    each = each.select("*", F.explode(F.sequence(F.lit(0), F.lit(STEPS - 1))).alias("at"))
    place = F.col("nth") * STEPS + F.col("at")
    own = F.instr(F.lit(FILTERS), F.substring("filter_order", F.col("at") + 1, F.lit(1))) - 1
    gone = F.aggregate(F.slice("counts", F.col("nth") * STEPS + 1, F.col("at") + 1), F.lit(0).cast("long"), lambda a, x: a + x)
    n = lambda k: F.get("counts", k)
    return each.select(
        "part",
        "filter_order",
        (F.col("at") + 1).alias("step"),
        (n(F.lit(ALL)) - gone).alias("kept"),
        n(place).alias("removed"),
        (n(FAILS + own) - n(place)).alias("redundant"),
        n(ALONE + own).alias("unique_fails"),
        n(REMOVED + place).alias("good_lost"),
        n(2 * REMOVED + place).alias("toxic_lost"),
        F.get("shares", own).alias("shapley"),
    )


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    """What each of the five filters removes from each source, in every order."""
    docs = S.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return audit(masks(docs, S.table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")))


ORACLE = r"""
    WITH said AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
    docs AS (SELECT d.doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM documents d LEFT JOIN said ON d.doc_id = said.doc_id),
    words AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM docs),
    failed AS (SELECT part, good, toxic, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > first, false)] AS f FROM words),
    grouped AS (SELECT part, f, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM failed GROUP BY part, f),
    k AS (SELECT unnest([1, 2, 3, 4, 5]) AS k),
    orders AS (SELECT [a.k, b.k, c.k, d.k, e.k] AS o FROM k a, k b, k c, k d, k e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
    steps AS (SELECT o, k.k AS step, o[k.k] AS own, array_to_string(list_transform(o, lambda i: 'ABCDE'[i]), '') AS filter_order FROM orders, k),
    met AS (SELECT part, filter_order, step, own, n, g, x, f, f[own] AS fails, list_bool_or(list_transform(o[1:step - 1], lambda i: f[i])) IS TRUE AS before FROM grouped, steps),
    counted AS (SELECT part, filter_order, step, own, sum(n) FILTER (NOT fails AND NOT before) AS kept, sum(n) FILTER (fails AND NOT before) AS removed, sum(n) FILTER (fails AND before) AS redundant,
                       sum(n) FILTER (fails AND len(list_filter(f, lambda y: y)) = 1) AS unique_fails, sum(g) FILTER (fails AND NOT before) AS good_lost, sum(x) FILTER (fails AND NOT before) AS toxic_lost FROM met GROUP BY ALL)
    SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
           coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, sum(coalesce(removed, 0)) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM counted"""
ORACLES = {"op13_filter_audit": ORACLE}
