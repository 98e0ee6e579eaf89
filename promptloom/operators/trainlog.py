"""Training logs: text lines to one row for each epoch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def epochs(df: DataFrame, column: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """``epoch, train_loss, eval_loss`` of each log text. An epoch's block starts with a line ``Epoch n:``; a loss that is missing or
    no number is null; text before the first epoch is left out."""
    blocks = F.expr(rf"filter(split({column}, '(?m)^(?=\\s*Epoch \\d+)'), b -> b rlike '^\\s*Epoch \\d+')")
    rows = df.select(*carry, F.explode(blocks).alias("b"))

    def loss(name: str):
        return F.expr(rf"try_cast(regexp_extract(b, '(?i){name}[^:\\n]*:\\s*([^\\s]+)', 1) as double)")

    return rows.select(*carry, F.regexp_extract("b", r"Epoch (\d+)", 1).cast("int").alias("epoch"), loss("train[a-z]* loss").alias("train_loss"), loss("eval[a-z]* loss").alias("eval_loss"))
