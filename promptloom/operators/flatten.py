"""Nested categories to flat prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NESTED = "map<string,map<string,array<string>>>"


def nested_map(df: DataFrame, column: str, carry: tuple[str, ...] = (), offset: str | None = None) -> DataFrame:
    """``category -> sub-category -> prompts`` of each row, one row for each prompt, with the three places: ``p1, p2, p3``.

    Keys keep the order of the map. Empty lists and maps give no rows; prompts are neither stripped nor filtered. A long
    list may come in blocks, one row each: ``offset`` is then the column with the number of prompts in the blocks before.
    """
    if offset is not None:
        return nested_map(df, column, (*carry, offset)).withColumn("p3", F.col("p3") + F.col(offset))
    level1 = df.select(*carry, F.posexplode(column).alias("p1", "category", "_subs"))
    level2 = level1.select(*carry, "p1", "category", F.posexplode("_subs").alias("p2", "sub_category", "_prompts"))
    return level2.select(*carry, "p1", "p2", F.posexplode("_prompts").alias("p3", "prompt"), "category", "sub_category")


def from_json_text(df: DataFrame, column: str) -> DataFrame:
    """The nested map of a whole JSON text; of a repeated key the last value counts."""
    return df.withColumn(column, F.from_json(column, NESTED))
