"""Bitmaps that tell which rows may be among some keys, before those rows are moved.

A bitmap is built by built-in functions, in pieces of 4 kB, and sized by the number of its keys: 16 bits
a key, so about one other row in 16 passes. Beyond MOST_BITS it grows no more; then it holds more keys
than it has room for, and lets more and more rows pass. What passes is always compared exactly, so a full
bitmap costs time and never changes a result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

#: 32 MB at most go to the driver and to each executor.
LEAST_BITS, MOST_BITS, BITS_A_KEY = 1 << 15, 1 << 28, 16


def size_for(n_keys: int) -> int:
    """A power of two."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_A_KEY * n_keys - 1).bit_length()))


@dataclass
class Filter:
    bits: int
    pieces: DataFrame  # piece, bits: at most MOST_BITS / 32768 rows

    def packed(self) -> np.ndarray:
        out = np.zeros(self.bits // 8, np.uint8)
        for r in self.pieces.collect():
            out[r["piece"] * 4096 : (r["piece"] + 1) * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
        return out

    def marked(self, rows: DataFrame, keys: Column, name: str) -> DataFrame:
        """rows with a boolean column: whether a key (a long) may be in the filter."""
        at = F.pmod(keys, F.lit(self.bits))
        pieces = F.broadcast(self.pieces.select(F.col("piece").alias("__piece"), F.col("bits").alias("__bits")))
        joined = rows.withColumn("__place", at).join(pieces, F.shiftright("__place", 15).cast("int") == F.col("__piece"), "left")
        byte = F.conv(F.hex(F.expr("substring(__bits, cast(shiftright(__place, 3) % 4096 as int) + 1, 1)")), 16, 10).cast("int")
        hit = F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, cast(__place % 8 as int))")) != 0, F.lit(False))
        return joined.withColumn(name, hit).drop("__place", "__piece", "__bits")


def filter_of(keys: DataFrame, name: str = "filter", outside: bool = False) -> Filter:
    """The filter of a table of one long column, which is read twice."""
    key = F.col(keys.columns[0])
    bits = size_for(keys.count())
    place = F.pmod(key, F.lit(bits)) + 1
    pieces = keys.select(place.alias("nth")).groupBy((F.bitmap_bucket_number("nth") - 1).cast("int").alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("nth")).alias("bits"))
    return Filter(bits, staged(pieces, name, outside))


def inside(packed: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which 64-bit values may be in a packed filter."""
    at = (values.view(np.uint64) & np.uint64(8 * len(packed) - 1)).astype(np.int64)
    return (packed[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
