"""Sharding by extendible hashing.

A directory is indexed by the leading bits of each document's hash. It begins with one
bucket, and only buckets above the byte limit split on one more bit, until every shard
fits. Sizes are summed once for prefixes some bits finer than shards of the limit would
need if all were full, and all buckets above are sums of those; documents are read again
for finer prefixes only where a bucket is still too large.

Defined cases: a null text has 0 bytes; a document that is longer than the limit, however
long, is a shard of its own as soon as bits tell it from others; rows with one and the same id get
an ordinal in their hash where together they exceed the limit, so they can split too; an
empty table gives an empty result; other columns, whatever their names, pass through.
Directories are tables, and rows reach their shard by a join on the prefix.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _spark as S

#: Bytes of text in a shard at most.
LIMIT = 32 << 20
#: Bits of the hash, and bits beyond the directory's that are summed in one round.
BITS, FINER = 48, 6


def hash_bits(key: Column) -> Column:
    """The first BITS bits of the MD5 of key."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null")).cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def prefix(hashed: Column, depth: int) -> Column:
    return F.shiftright(hashed, BITS - depth)


def directory(sizes: DataFrame, depth: int, finest: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """Leaves (depth, prefix, shard_bytes, shard_docs) among the prefixes of `finest` bits in sizes (fine, n_bytes, n_docs), and the buckets of `finest` bits that are still too large."""
    levels = sizes.select("*", F.explode(F.sequence(F.lit(depth), F.lit(finest))).alias("depth"))
    levels = levels.groupBy("depth", F.expr(f"shiftright(fine, {finest} - depth)").alias("prefix")).agg(F.sum("n_bytes").alias("shard_bytes"), F.sum("n_docs").alias("shard_docs"))
    levels = levels.withColumn("fits", (F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1))
    above = levels.where("not fits").select((F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix"))
    # a leaf fits and its parent doesn't, or it is at the first depth
    leaves = levels.where("fits").join(above, ["depth", "prefix"], "left_semi").unionByName(levels.where(F.col("fits") & (F.col("depth") == depth)))
    return leaves.drop("fits"), levels.where(~F.col("fits") & (F.col("depth") == finest)).select(F.col("prefix").alias("fine"))


def shards(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """Per row of docs: its columns, n_bytes, shard (bits of the hash as 0 and 1), depth, shard_bytes and shard_docs; a name that docs has gets an underscore."""
    names = {n: S.free_name(docs, n) for n in ("n_bytes", "shard", "depth", "shard_bytes", "shard_docs")}
    hashed, key, size = S.free_name(docs, "_hash"), F.col(doc_id), names["n_bytes"]
    rows = docs.withColumn(size, F.coalesce(F.octet_length(text), F.lit(0)).cast("long")).withColumn(hashed, hash_bits(key))
    small = rows.select(F.col(hashed).alias("hash"), F.col(size).alias("n_bytes"))
    same = S.cut(small.groupBy("hash").agg(F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n_docs")))
    large = same.where((F.col("n_bytes") > limit) & (F.col("n_docs") > 1)).select(F.col("hash").alias(hashed))
    if not large.isEmpty():
        # rows of one id that exceed a shard: their hash is that of the id and of their place among its rows
        nth = S.free_name(rows, "_nth")
        one = S.running_total(rows.join(large, hashed, "left_semi"), [hashed, size], F.lit(1), nth)
        again = one.withColumn(hashed, hash_bits(F.concat_ws(":", key.cast("string"), nth))).drop(nth)
        rows = S.cut(rows.join(large, hashed, "left_anti").unionByName(again))
        same = S.cut(rows.select(F.col(hashed).alias("hash"), F.col(size).alias("n_bytes")).groupBy("hash").agg(F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n_docs")))
    total = same.agg(F.sum("n_bytes")).first()[0] or 0
    # the finest prefixes of the first round are FINER bits beyond full shards
    leaves, open_, start, finest = None, None, 0, min(BITS, max(0, math.floor(math.log2(max(1, total / limit)))) + FINER)
    while True:
        sizes = same if open_ is None else same.withColumn("coarse", prefix(F.col("hash"), start)).join(open_, F.col("coarse") == F.col("fine"), "left_semi")
        sizes = sizes.groupBy(prefix(F.col("hash"), finest).alias("fine")).agg(F.sum("n_bytes").alias("n_bytes"), F.sum("n_docs").alias("n_docs"))
        found, open_ = directory(S.cut(sizes), start, finest, limit)
        found = S.cut(found.where(F.col("depth") > start) if start else found)
        leaves = found if leaves is None else leaves.unionByName(found)
        open_ = S.cut(open_)
        if finest == BITS or open_.isEmpty():
            break
        start, finest = finest, min(BITS, finest + FINER)
    if finest == BITS:  # hashes that no bit tells apart
        last = same.join(open_, F.col("hash") == F.col("fine"), "left_semi").select(F.lit(BITS).alias("depth"), F.col("hash").alias("prefix"), F.col("n_bytes").alias("shard_bytes"), F.col("n_docs").alias("shard_docs"))
        leaves = leaves.unionByName(last)
    leaves = S.cut(leaves)
    depths = sorted(r[0] for r in leaves.select("depth").distinct().collect())  # BITS at most
    # each hash looks for its leaf at every depth that leaves have
    tried = F.array(*(F.struct(F.lit(d).alias("depth"), prefix(F.col("hash"), d).alias("prefix")) for d in depths or [0]))
    hashes = same.select("hash", F.explode(tried).alias("at")).select("hash", "at.*")
    placed = hashes.join(leaves, ["depth", "prefix"]).select(F.col("hash").alias(hashed), F.when(F.col("depth") > 0, F.expr("lpad(bin(prefix), depth, '0')")).otherwise("").alias(names["shard"]), F.col("depth").cast("int").alias(names["depth"]), F.col("shard_bytes").alias(names["shard_bytes"]), F.col("shard_docs").alias(names["shard_docs"]))
    return rows.join(placed, hashed).select(*docs.columns, *names.values())


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    """Every document's shard."""
    docs = S.table(spark, sf_dir, "documents").select("doc_id", "text")
    return shards(docs).drop("text")


def oracle(limit: int = LIMIT) -> str:
    """The same as SQL, for any limit."""
    return f"""
    WITH docs AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT AS hash FROM documents),
    levels AS (SELECT d AS depth, hash >> ({BITS} - d) AS prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs FROM docs, range(0, {BITS} + 1) r(d) GROUP BY ALL),
    leaves AS (SELECT prefix, depth, shard_bytes, shard_docs FROM levels WHERE shard_bytes <= {limit} OR shard_docs = 1 OR depth = {BITS}),
    found AS (SELECT doc_id, n_bytes, arg_min(l, depth) AS l FROM docs JOIN leaves l ON prefix = hash >> ({BITS} - depth)::INT GROUP BY ALL)
    SELECT doc_id, n_bytes, CASE WHEN l.depth = 0 THEN '' ELSE lpad(bin(l.prefix), l.depth::INT, '0') END AS shard, l.depth::INT AS depth, l.shard_bytes AS shard_bytes, l.shard_docs AS shard_docs FROM found"""


ORACLES = {"op5_sharding": oracle()}
