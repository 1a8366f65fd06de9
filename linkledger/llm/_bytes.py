"""Vectorised helpers over the UTF-8 bytes of many texts at once.

All of them work on slabs: the concatenated bytes of some documents with their
offsets, a few megabytes at a time, so a task's memory is bounded by one slab or
by its longest document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
SPACES = bytes([0x20, *range(0x09, 0x0E)])


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    out = np.ones(max(1, n), dtype=U64)
    size = 1
    while size < n:
        step = min(size, n - size)
        out[size : size + step] = out[:step] * U64(pow(base, size, 1 << 64))
        size += step
    return out[:n]


_POWERS: dict[int, np.ndarray] = {}


def power_table(base: int, n: int) -> np.ndarray:
    """powers(), kept between the slabs of a worker."""
    if base not in _POWERS or len(_POWERS[base]) < n:
        _POWERS[base] = powers(base, max(n, 1 << 16))
    return _POWERS[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def mix_int(x: int) -> int:
    return int(mix(np.array([x % (1 << 64)], dtype=U64))[0])


def byte_values(seed: int) -> np.ndarray:
    """A fixed random 64-bit value for each byte."""
    return mix(np.arange(1, 257, dtype=U64) * U64(BASE) + U64(seed))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and their offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.cast(pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else ""), pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def slabs(off: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of documents of up to `most` bytes, or of one longer document."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi
        lo = hi


class Words:
    """Word positions and 64-bit word hashes in a slab.

    `separators`: bytes that belong to no word. A-Z count as a-z if `fold` is set.
    """

    def __init__(self, separators: bytes, seed: int = 1, fold: bool = True) -> None:
        self.inside = np.ones(256, bool)
        self.inside[np.frombuffer(separators, np.uint8)] = False
        self.value = byte_values(seed)
        if fold:
            self.value[65:91] = self.value[97:123]
        self.value[~self.inside] = 0

    def find(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and the index of the first word of each document (one more at the end)."""
        n = len(buf)
        inside = self.inside[buf]
        first, last = inside.copy(), inside.copy()
        if n:
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            heads, tails = off[:-1][off[:-1] < off[1:]], off[1:][off[:-1] < off[1:]] - 1
            first[heads] = inside[heads]
            last[tails] = inside[tails]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        return starts, ends, np.searchsorted(starts, off)

    def hash(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros(0, U64)
        weighed = self.value[buf] * power_table(BASE, len(buf))
        sums = np.add.reduceat(weighed, starts)
        return mix(sums * power_table(INVERSE, len(buf))[starts] + (ends - starts).astype(U64))


def spans_of(hashes: np.ndarray, n: int, factor: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """The hash of each n consecutive word hashes, wherever they start."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    out = np.zeros(m, U64)
    for k in range(n):
        out *= U64(factor)
        out += hashes[k : k + m]
    return mix(out + U64(n))


def start_document(first_word: np.ndarray, n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Of m spans of n words: which lie in one document, and the document of each word."""
    of = np.repeat(np.arange(len(first_word) - 1), np.diff(first_word))
    return (of[:m] == of[n - 1 : n - 1 + m]) if m > 0 else np.zeros(0, bool), of


def same(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are among `known` (sorted). A table of bits turns most others away first."""
    if not len(known) or not len(values):
        return np.zeros(len(values), bool)
    bits = max(10, min(24, int(len(known)).bit_length() + 3))
    shift, table = U64(64 - bits), np.zeros(1 << bits, bool)
    table[(known * U64(BASE)) >> shift] = True
    found = table[(values * U64(BASE)) >> shift]
    at = np.flatnonzero(found)
    where = np.searchsorted(known, values[at])
    where[where == len(known)] = 0
    found[at] = known[where] == values[at]
    return found
