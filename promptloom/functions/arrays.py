"""Column expressions for arrays: token batches and class scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fit_length(ids: Column, size: int | Column, pad: int) -> Column:
    """Cut to ``size`` or filled up on the right; null for null."""
    size = F.lit(size) if isinstance(size, int) else size
    return F.concat(F.slice(ids, F.lit(1), size), F.array_repeat(F.lit(pad), F.greatest(size - F.size(ids), F.lit(0))))


def attention_mask(ids: Column, size: int | Column) -> Column:
    """1 for each kept id, 0 for filling."""
    size = F.lit(size) if isinstance(size, int) else size
    kept = F.least(F.size(ids), size)
    return F.when(ids.isNotNull(), F.concat(F.array_repeat(F.lit(1), kept), F.array_repeat(F.lit(0), size - kept)))


def softmax(scores: Column) -> Column:
    """Probabilities of scores, shifted by the largest so that none overflows; empty for empty."""
    top = F.array_max(scores)
    powers = F.transform(scores, lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.transform(powers, lambda x: x / total)


def argmax(scores: Column) -> Column:
    """0-based place of the largest, the first of equals; -1 for empty."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")
