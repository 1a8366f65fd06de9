"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Targets: sources, by code point and null last, weigh WEIGHTS in turn and share SHARE of
all words; a target stops at MOST times its source, and the excess goes to the others by
weight until none is above. That fixed point needs one pass over the sources in the order
of size by weight. Within a source every document is taken in each complete epoch of the
target; the rest of the target goes to documents in ascending order of an exponential
key, -ln(u) / quality, of which the sizes are summed up to the budget; the document in
which the budget ends gives the words that are left.

Defined cases: null and blank texts have size 0 and are never taken; an all-null source
column is one source; equal keys are ordered by doc_id, then size, then the text's hash,
so that rows with equal or no ids have one order in every run, however they are dealt out;
rows equal in all of these share their places, and it doesn't show which has which; very
long texts are counted whole; an empty table gives an empty result; other columns, whatever
their names, are not read, and `mixed_documents` passes them on. A hot source doesn't meet
in one task: prefix sums run over ranges of (source, key, doc_id, ...) of all sources. Only
the table of sources, one row each, is summed in a single task; it is broadcast if it has
SOURCES rows at most, and joined otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _spark as S

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
WORD = r"[^\x20\x09-\x0D]+"
#: Words of a text from which its quality weight is full.
ENOUGH = 100
#: Sources up to which their table is broadcast: some 10 MB.
SOURCES = 100_000


def uniform(doc_id: Column, seed: str = "mix") -> Column:
    """A number in (0, 1) that depends on the id alone."""
    digest = F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary")), 1, 12)
    return (F.conv(digest, 16, 10).cast("double") + 0.5) / F.lit(float(16**12))


def quality(size: Column, n_chars: Column) -> Column:
    """The quality weight: 1 for texts of ENOUGH words of usual length, down to a quarter for short texts and odd words."""
    length = F.coalesce(n_chars / F.nullif(size, F.lit(0)), F.lit(0.0))
    return F.when(size >= ENOUGH, 1.0).otherwise(0.5) * F.when((length >= 4) & (length <= 12), 1.0).otherwise(0.5)


def targets(sources: DataFrame) -> DataFrame:
    """sources (source, source_size) with rank (from 0), target, and before: the words of all earlier sources."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("rank", F.row_number().over(order) - 1).withColumn("weight", F.get(F.array(*(F.lit(float(w)) for w in WEIGHTS)), F.col("rank") % len(WEIGHTS)))
    ranked = ranked.withColumn("before", F.coalesce(F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # sources are full from the least size by weight on; below the first that isn't, the level is even
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything) * SHARE
    left = total - MOST * F.coalesce(F.sum("source_size").over(fill), F.lit(0))
    level = left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(fill), F.lit(0.0)))
    levels = ranked.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") < MOST * F.col("source_size"))
    even = F.min(F.when(F.col("open"), F.struct((F.col("source_size") / F.col("weight")).alias("at"), "rank", "level"))).over(everything)["level"]
    return levels.withColumn("even", even).withColumn("target", F.coalesce(F.least(MOST * F.col("source_size"), F.col("even") * F.col("weight")), MOST * F.col("source_size"))).select("source", "source_size", "rank", "before", "target")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Per row of docs: doc_id, source, size, hash (of the text), source_size, target and taken."""
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words.alias("size"), F.coalesce(F.length(text), F.lit(0)).alias("chars"), F.xxhash64(text).alias("hash"))
    sized = S.cut(sized.select("doc_id", "source", "size", "hash", (-F.log(uniform(F.col("doc_id"))) / quality(F.col("size"), F.col("chars"))).alias("key")))
    goals = S.cut(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")))).withColumnRenamed("source", "_source")
    goals = F.broadcast(goals) if goals.count() <= SOURCES else goals
    placed = sized.join(goals, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    placed = S.running_total(placed, ["rank", "key", "doc_id", "size", "hash"], "size", "ahead")
    # whole epochs, then the words left of the target in the order of the keys
    goal = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("long")
    rest = goal - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - (F.col("ahead") - F.col("before"))))
    return placed.select("doc_id", "source", "size", "hash", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix: each row of docs as often as its text is taken, the last one of a source if half of it is at least.

    Rows with equal id, source and text are taken equally often, as the one that is taken most.
    """
    names = [S.free_name(docs, n) for n in ("_own", "_source", "_hash", "_copies", "_nth")]
    own, of, hashed, copies, nth = names
    taken = mix(docs, doc_id, text, source).where("size > 0").groupBy("doc_id", "source", "hash").agg(F.max(F.floor(F.col("taken") / F.col("size") + 0.5)).alias(copies))
    wanted = taken.where(F.col(copies) > 0).select(F.col("doc_id").alias(own), F.col("source").alias(of), F.col("hash").alias(hashed), copies)
    same = F.col(doc_id).eqNullSafe(F.col(own)) & F.col(source).eqNullSafe(F.col(of)) & (F.xxhash64(text) == F.col(hashed))
    repeated = docs.join(wanted, same).withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(copies))))
    return repeated.drop(*names)


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mix(S.table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
    WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, length(coalesce(text, '')) AS chars FROM documents),
    keyed AS (SELECT *, chars / nullif(size, 0) AS avg_len, (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u FROM sized),
    weighed AS (SELECT doc_id, source, size, -ln(u) / ((CASE WHEN size >= 100 THEN 1.0 ELSE 0.5 END) * (CASE WHEN avg_len BETWEEN 4 AND 12 THEN 1.0 ELSE 0.5 END))::DOUBLE AS key FROM keyed),
    sources AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM weighed GROUP BY source),
    ranked AS (SELECT *, [5.0, 2.0, 1.0][((rank - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM sources),
    filled AS (SELECT *, (1.5 * sum(source_size) OVER () - 2 * coalesce(sum(source_size) OVER f, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0)) AS level,
                      row_number() OVER (ORDER BY source_size / weight, rank) AS nth
               FROM ranked WINDOW f AS (ORDER BY source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    even AS (SELECT arg_min(level, nth) AS even FROM filled WHERE level * weight < 2.0 * source_size),
    goals AS (SELECT source, source_size, coalesce(least(2.0 * source_size, even * weight), 2.0 * source_size)::DOUBLE AS target FROM filled, even),
    ahead AS (SELECT w.doc_id, w.size, g.source_size, g.target, round(g.target)::BIGINT AS goal, coalesce(sum(w.size) OVER (PARTITION BY w.source ORDER BY key, doc_id, w.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
              FROM weighed w JOIN goals g ON w.source IS NOT DISTINCT FROM g.source),
    parts AS (SELECT *, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS epochs FROM ahead)
    SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, goal - epochs * source_size - ahead)))::BIGINT AS taken FROM parts"""
ORACLES = {"op8_mixing": ORACLE}
