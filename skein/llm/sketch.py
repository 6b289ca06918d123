"""A frequency sketch of bounded size, for telling common keys from rare ones.

Every task counts its keys in one array of 2**BITS cells and hands it on in
chunks; the chunks are added up per chunk number and reduced to one byte a
cell, the binary logarithm of its count. Whatever the corpus, the driver gets
2**BITS bytes, and executors get the same by broadcast. A cell's count is at
least the count of each of its keys.

A filter of bounded size, of 2**MARK_BITS bits, two a key, is made in the same
way. It has every key it was made of, and may seem to have others.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BITS, CHUNKS = 22, 64
MARK_BITS = 26


def cells(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def frequency_levels(df: DataFrame, hashes: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """One uint8 a cell: the bit length of its count over all rows of df.

    A task hands on counts to an eighth of a power of two, rounded up, in one
    byte each, so that no count stops short however many rows a task has.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BITS, np.uint32)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount(cells(hashes(batch)), minlength=1 << BITS).astype(np.uint32)
        if total.any():
            parts = np.ceil(8 * np.log2(total + 1.0)).astype(np.uint8).reshape(CHUNKS, -1)
            yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["chunk", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros((1 << BITS) // CHUNKS, np.uint64)
        counts = np.floor(np.exp2(np.arange(256) / 8) - 1 + 1e-6).astype(np.uint64)
        for batch in table.to_batches(max_chunksize=16):
            for x in batch["counts"].to_pylist():
                total += counts[np.frombuffer(x, np.uint8)]
        level = np.zeros(len(total), np.uint8)
        for bit in range(48):
            level[total >= np.uint64(1 << bit)] = bit + 1
        return pa.table({"chunk": table["chunk"][:1], "level": pa.array([level.tobytes()], pa.binary())})

    rows = df.mapInArrow(count, "chunk int, counts binary").groupBy("chunk").applyInArrow(add, "chunk int, level binary").collect()
    out = np.zeros((CHUNKS, (1 << BITS) // CHUNKS), np.uint8)
    for r in rows:
        out[r.chunk] = np.frombuffer(r.level, np.uint8)
    return out.reshape(-1)


def hot_level(levels: np.ndarray, least: int = 8, above_mean: int = 3) -> int:
    """The bit length from which a cell counts as common: 2**(least - 1) occurrences, and well above the mean cell."""
    mean = float(np.mean(np.exp2(levels.astype(np.float64)) / 2)) if len(levels) else 0.0
    return max(least, int(mean).bit_length() + above_mean)


def _places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h >> np.uint64(64 - MARK_BITS)).astype(np.int64), (h & np.uint64((1 << MARK_BITS) - 1)).astype(np.int64)


def marked(marks: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the filter may have each key; True for all that it was made of."""
    a, b = ((marks[at >> 3] >> (at & 7).astype(np.uint8)) & 1 for at in _places(h))
    return (a & b).astype(bool)


def marks_of(df: DataFrame, hashes: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The filter of all keys of df, eight bits a cell."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << (MARK_BITS - 3), np.uint8)
        for batch in batches:
            for at in _places(hashes(batch)):
                np.bitwise_or.at(bits, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        if bits.any():
            parts = bits.reshape(CHUNKS, -1)
            yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())], names=["chunk", "bits"])

    def join(table: pa.Table) -> pa.Table:
        total = np.zeros((1 << (MARK_BITS - 3)) // CHUNKS, np.uint8)
        for x in table["bits"]:
            total |= np.frombuffer(zlib.decompress(x.as_py()), np.uint8)
        return pa.table({"chunk": table["chunk"][:1], "bits": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    out = np.zeros((CHUNKS, (1 << (MARK_BITS - 3)) // CHUNKS), np.uint8)
    for r in df.mapInArrow(mark, "chunk int, bits binary").groupBy("chunk").applyInArrow(join, "chunk int, bits binary").collect():
        out[r.chunk] = np.frombuffer(zlib.decompress(r.bits), np.uint8)
    return out.reshape(-1)
