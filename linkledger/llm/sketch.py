"""A set of ids as a broadcast of a fixed number of bits; ids that share bits only cost work."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B

#: 4 MB, whatever the number of ids.
SKETCH_BITS = 1 << 25


def _slots(ids: pa.Array) -> np.ndarray:
    return (B.mix(ids.to_numpy(zero_copy_only=False).astype(np.int64).view(B.U64)) % B.U64(SKETCH_BITS)).astype(np.int64)


def in_sketch(sketch, ids: pa.Array) -> np.ndarray:
    """Whether each id has its bit."""
    bits, slot = np.frombuffer(sketch.value, np.uint8), _slots(ids)
    return (bits[slot >> 3] >> (slot & 7)) & 1 == 1


def sketch_of(ids: DataFrame, column: str):
    """A bit for each id in the column."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array(np.unique(_slots(batch.column(0))))], ["slot"])

    slots = ids.select(F.col(column).cast("long")).mapInArrow(bits, "slot long")
    maps = slots.groupBy((F.col("slot") / 32768).cast("long").alias("page")).agg(F.expr("bitmap_construct_agg(slot % 32768)").alias("bits"))
    out = bytearray(SKETCH_BITS // 8)
    for row in maps.collect():  # a row for each page, 4 MB in all
        out[row["page"] * 4096 : row["page"] * 4096 + 4096] = row["bits"]
    return ids.sparkSession.sparkContext.broadcast(bytes(out))
