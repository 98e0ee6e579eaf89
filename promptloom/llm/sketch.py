"""A set of hashes as a bit array of fixed size: what it lets pass is a superset, whatever the number of hashes.

It saves work as long as the hashes are few against its bits: with a quarter as many it lets a fifth of all others pass, with as many
nearly two thirds, and beyond that it saves nothing. Results never depend on it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a filter: 4 MB, the most that is ever collected and sent to the executors, at any input size.
FILTER_BITS = 25


def collect_filter(df: DataFrame, hash_: Column, bits: int = FILTER_BITS) -> np.ndarray:
    """The filter of a hash column. Words of 64 bits are combined on the executors; at most 2**(bits-6) rows come back."""
    slot = F.shiftrightunsigned(hash_, 64 - bits)
    words = df.select(F.shiftright(slot, 6).alias("w"), F.expr("1L").alias("one"), slot.bitwiseAND(F.lit(63)).cast("int").alias("b"))
    words = words.select("w", F.expr("shiftleft(one, b)").alias("v")).groupBy("w").agg(F.bit_or("v").alias("v"))
    got = words.toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[got["w"].to_numpy()] = got["v"].to_numpy().view(np.uint64) if got.num_rows else 0
    return out


def passes(filter_: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bits = len(filter_).bit_length() - 1 + 6
    slot = hashes.astype(np.uint64) >> np.uint64(64 - bits)
    return (filter_[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def likely(rows: DataFrame, met: DataFrame, hash_: str, bits: int = FILTER_BITS) -> DataFrame:
    """The rows whose hash column is one of ``met``'s, and a few others: before a shuffle of long rows of which few are wanted.

    The bits are joined as a broadcast table of at most 2**(bits-6) rows of two numbers.
    """
    slot = F.shiftrightunsigned(F.col(hash_), 64 - bits)
    word, bit = F.shiftright(slot, 6), F.expr(f"shiftleft(1L, cast(shiftrightunsigned({hash_}, {64 - bits}) & 63 as int))")
    words = met.select(word.alias("_word"), bit.alias("_bits")).groupBy("_word").agg(F.bit_or("_bits").alias("_bits"))
    return rows.withColumn("_word", word).join(F.broadcast(words), "_word").filter(F.col("_bits").bitwiseAND(bit) != 0).drop("_word", "_bits")
