"""Deterministic buckets that SQL engines agree on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bucket(key: Column, n: int) -> Column:
    """0 .. n-1 by the first 32 bits of the key's MD5; null for null."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint"), F.lit(n)).cast("int")
