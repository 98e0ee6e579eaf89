"""Batches of token lists, each filled up to its own longest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from promptloom.functions import arrays
from promptloom.operators.position import with_position


def padded_batches(df: DataFrame, order: list[str], ids: str, batch_size: int = 32, most: int = 512, pad: int = 0) -> DataFrame:
    """``batch, ids, attention_mask`` and the order columns: consecutive rows form batches; lists are cut to ``most`` and filled up to the
    longest of their batch. A null list counts as empty.

    A window spans one batch only.
    """
    rows = df.select(*order, F.coalesce(F.slice(ids, 1, most), F.array().cast(df.schema[ids].dataType)).alias("ids"))
    rows = with_position(rows, order, "_pos").withColumn("batch", F.floor(F.col("_pos") / batch_size).cast("bigint"))
    longest = F.max(F.size("ids")).over(W.partitionBy("batch"))
    rows = rows.withColumn("_longest", longest)
    return rows.select(*order, "batch", arrays.fit_length(F.col("ids"), F.col("_longest"), pad).alias("ids"), arrays.attention_mask(F.col("ids"), F.col("_longest")).alias("attention_mask"))
