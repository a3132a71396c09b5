"""Bloom filters of fixed size: rows that a join would drop stay out of its shuffle.

A filter never loses a match, and the join that follows drops what it lets through, so results are exact at
any fill. Its bits (4 MB) are all that comes to the driver and goes to the tasks, whatever the input."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: log2 of the number of bits, bits set per string, and how far apart they are taken from the hash.
LOG_BITS, PLACES, STEP = 25, 4, 13


def filter_of(df: DataFrame, column: str) -> bytes:
    """The filter of a string column."""
    mask, hashed = (1 << LOG_BITS) - 1, F.xxhash64(column)
    places = F.array(*[F.shiftrightunsigned(hashed, i * STEP).bitwiseAND(F.lit(mask)) for i in range(PLACES)])
    words = df.select(F.explode(places).alias("place")).select(
        F.shiftright("place", 6).alias("word"), F.expr("shiftleft(1L, cast(place & 63 as int))").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most 2 ** (LOG_BITS - 6) rows
    bits = np.zeros(1 << (LOG_BITS - 6), np.int64)
    bits[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return bits.tobytes()


def may_hold(bits: bytes, words: list[bytes]) -> np.ndarray:
    """Which of the strings (UTF-8) the filter may hold."""
    table = np.frombuffer(bits, np.uint64)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words), np.uint64, len(words))  # Spark's xxhash64
    found = np.ones(len(words), bool)
    for i in range(PLACES):
        place = (hashes >> np.uint64(i * STEP)) & np.uint64((1 << LOG_BITS) - 1)
        found &= (table[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
    return found
