"""Counting Bloom filters, sharded by hash, that tell which keys may occur more than once.

A shard has at most ``MAX_BITS`` cells, and the number of shards follows the number of rows, so a filter
is as sparse at any size and what is broadcast at once has a fixed bound.  Tasks count the cells of
their own keys, stopping at two, and pass on only these counts, as compressed lists of cells
for each ``SEGMENT`` of the filter; one task adds up a segment.  So no row is shuffled to build a filter, and
a key that stands in a third of all rows is one entry of each task.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.storage import materialize

BITS_PER_ROW = 16
MAX_BITS = 1 << 28
SEGMENT = 1 << 20
HELD = 1 << 22
_MANY = 2


def size_for(rows: int) -> tuple[int, int]:
    """How many shards, and the cells of each (a power of two), for so many rows."""
    total = max(1, rows) * BITS_PER_ROW
    shards = -(-total // MAX_BITS)
    return shards, min(MAX_BITS, max(1 << 16, 1 << (-(-total // shards) - 1).bit_length()))


def cells(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two cells of 64-bit keys, which are hashes already: their low and their high bits."""
    keys, low = keys.view(np.uint64), np.uint64(bits - 1)
    return (keys & low).astype(np.int64), ((keys >> np.uint64(32)) & low).astype(np.int64)


def _packed(at: np.ndarray) -> bytes:
    return zlib.compress(np.diff(at, prepend=0).astype(np.uint32).tobytes(), 1)


def _unpacked(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(packed), np.uint32), dtype=np.int64)


def counts(shard: np.ndarray, keys: np.ndarray, bits: int, size: int) -> list[tuple[int, int, bytes, bytes]]:
    """``shard, segment (of size cells), cells hit once, cells hit more often`` by some rows."""
    both, hits = np.unique(np.stack([shard, keys.view(np.int64)], 1), axis=0, return_counts=True)
    a, b = cells(np.ascontiguousarray(both[:, 1]), bits)
    other = a != b
    at = np.concatenate([both[:, 0] * bits + a, (both[:, 0] * bits + b)[other]])
    at, where = np.unique(at, return_inverse=True)
    hits = np.bincount(where, np.concatenate([hits, hits[other]]))
    segment, at = at // size, at % size
    cut = np.concatenate([[0], np.flatnonzero(np.diff(segment)) + 1, [len(segment)]]).tolist()
    per = bits // size
    return [(int(segment[lo]) // per, int(segment[lo]) % per, _packed(at[lo:hi][hits[lo:hi] < _MANY]), _packed(at[lo:hi][hits[lo:hi] >= _MANY])) for lo, hi in zip(cut[:-1], cut[1:], strict=True) if hi > lo]


def repeated(rows: DataFrame, bits: int) -> DataFrame:
    """``shard, segment, bitmap``: the cells of the filters over ``_shard, _key`` that at least two rows hit."""
    size = min(bits, SEGMENT)

    def count(batches):
        shard, keys = [], []

        def out():
            found = counts(np.concatenate(shard), np.concatenate(keys), bits, size)
            shard.clear()
            keys.clear()
            for lo in range(0, len(found), 64):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found[lo : lo + 64], strict=True)], names=["shard", "segment", "once", "more"])

        for batch in batches:
            shard.append(batch.column(0).to_numpy().astype(np.int64))
            keys.append(batch.column(1).to_numpy())
            if sum(map(len, keys)) >= HELD:
                yield from out()
        if keys:
            yield from out()

    def add(batches):
        held, hits = None, np.zeros(0, np.uint8)

        def done():
            return pa.RecordBatch.from_arrays([pa.array([held[0]]), pa.array([held[1]]), pa.array([np.packbits(hits >= _MANY, bitorder="little").tobytes()])], names=["shard", "segment", "bitmap"])

        for batch in batches:
            for s, g, once, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (s, g) != held:
                    if held:
                        yield done()
                    held, hits = (s, g), np.zeros(size, np.uint8)
                at = _unpacked(once)
                hits[at] = np.minimum(hits[at] + 1, _MANY)
                hits[_unpacked(more)] = _MANY
        if held:
            yield done()

    local = rows.select("_shard", "_key").mapInArrow(count, "shard long, segment long, once binary, more binary")
    return materialize(local.repartition("shard", "segment").sortWithinPartitions("shard", "segment").mapInArrow(add, "shard long, segment long, bitmap binary"))


def fetch(bitmaps: DataFrame, shard: int, bits: int) -> np.ndarray:
    """The filter of one shard, ``bits / 8`` bytes."""
    out = np.zeros(bits // 8, np.uint8)
    size = min(bits, SEGMENT) // 8
    found = bitmaps.filter(F.col("shard") == shard).toArrow()
    for g, b in zip(found.column("segment").to_pylist(), found.column("bitmap").to_pylist(), strict=True):
        out[g * size : (g + 1) * size] = np.frombuffer(b, np.uint8)
    return out


def contains(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the 64-bit keys the filter may hold."""
    found = np.ones(len(keys), bool)
    for cell in cells(keys, len(bitmap) * 8):
        found &= (bitmap[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1
    return found
