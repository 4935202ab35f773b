"""Bounded summaries of any amount of hashes: counts by bucket, and Bloom filters.

Their sizes follow from how much there is to hold, up to a fixed most.  Tasks send compressed pieces of
their arrays, which are put together piece by piece as they stream in; the driver gets one array of at
most ``2**MOST_COUNTS`` or ``2**MOST_BLOOM / 8`` bytes, so it may be broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidewatch.runtime import ship

LEAST_BITS, MOST_COUNTS, MOST_BLOOM = 17, 24, 28
PIECE = 1 << 17
PIECES = T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("data", T.BinaryType())])


def bits_for(n: int, most: int) -> int:
    """The power of two that holds ``n``, within bounds."""
    return min(max(int(n).bit_length(), LEAST_BITS), most)


def pieces(array: np.ndarray) -> pa.RecordBatch:
    """The non-zero pieces of an array of bytes."""
    parts = array.reshape(-1, min(PIECE, array.size))
    used = np.flatnonzero(parts.any(axis=1))
    z = zstandard.ZstdCompressor(level=1)
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([z.compress(parts[i].tobytes()) for i in used], pa.binary())], names=["piece", "data"])


def add(counts: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Sum that stays at 255."""
    total = counts + more
    total[total < more] = 255
    return total


def tally(counts: np.ndarray, h: np.ndarray) -> None:
    """Count 64-bit hashes by their leading bits."""
    bucket, n = np.unique(h >> np.uint64(64 - (counts.size.bit_length() - 1)), return_counts=True)
    bucket = bucket.astype(np.int64)
    counts[bucket] = add(counts[bucket], np.minimum(n, 255).astype(np.uint8))


def count_of(counts: np.ndarray, h: np.ndarray) -> np.ndarray:
    return counts[(h >> np.uint64(64 - (counts.size.bit_length() - 1))).astype(np.int64)]


def gather(parts: DataFrame, size: int, union: bool = False) -> np.ndarray:
    """Saturating sum (or bitwise union) of all pieces, as one array of ``size`` bytes."""
    ship(parts.sparkSession)

    def run(batches):
        held: dict[int, np.ndarray] = {}
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            for piece, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.frombuffer(z.decompress(data), np.uint8)
                held[piece] = x if piece not in held else held[piece] | x if union else add(held[piece], x)
        if held:
            c = zstandard.ZstdCompressor(level=1)
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([c.compress(x.tobytes()) for x in held.values()], pa.binary())], names=["piece", "data"])

    out, z, width = np.zeros(size, np.uint8), zstandard.ZstdDecompressor(), min(PIECE, size)
    for r in parts.repartition("piece").mapInArrow(run, PIECES).collect():
        out[r.piece * width : (r.piece + 1) * width] = np.frombuffer(z.decompress(bytes(r.data)), np.uint8)
    return out


def _bits(h: np.ndarray, bits: int) -> list[np.ndarray]:
    h = h.view(np.uint64)
    a = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
    b = ((h ^ (h >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - bits)
    return [a.astype(np.int64), b.astype(np.int64), ((a + np.uint64(7) * b + np.uint64(1)) & np.uint64((1 << bits) - 1)).astype(np.int64)]


def bloom(keys: DataFrame, n: int) -> np.ndarray:
    """A filter over a column of about ``n`` 64-bit hashes, ten bits or more for each; beyond the most it lets more through, but never less."""
    ship(keys.sparkSession)
    bits = bits_for(10 * n, MOST_BLOOM)

    def run(batches):
        held = np.zeros(1 << (bits - 3), np.uint8)
        for batch in batches:
            for at in _bits(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), bits):
                np.bitwise_or.at(held, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        yield pieces(held)

    return gather(keys.mapInArrow(run, PIECES), 1 << (bits - 3), union=True)


def may_hold(filter_: np.ndarray, h: np.ndarray) -> np.ndarray:
    ok = np.ones(h.size, bool)
    for at in _bits(h, filter_.size.bit_length() + 2):
        ok &= (filter_[at >> 3] >> (at & 7).astype(np.uint8)) & np.uint8(1) == 1
    return ok
