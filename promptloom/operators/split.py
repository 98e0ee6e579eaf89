"""Training frame: encoded labels, dropped nulls, reproducible splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptloom.functions import hashing
from promptloom.operators.lowest import priority, split_lowest


def encoded(label: Column) -> Column:
    """0 for ``safe``, 1 for ``unsafe``, null for anything else; letter case matters."""
    return F.when(label == "safe", 0).when(label == "unsafe", 1).cast("int")


def training_frame(df: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """``text, label`` and carried columns: the prompt renamed, the label encoded, rows without either dropped."""
    return df.select(*carry, F.col("prompt").alias("text"), encoded(F.col("label")).alias("label")).dropna(subset=["text", "label"])


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows of each value that is not null, the most frequent first, then by value."""
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def hash_split(df: DataFrame, key: str, test_percent: int = 20) -> DataFrame:
    """``fold``: ``test`` for about ``test_percent`` of the keys, by their hash. Equal under any partitioning; no shuffle."""
    return df.withColumn("fold", F.when(hashing.bucket(F.col(key), 100) < test_percent, "test").otherwise("train"))


def exact_split(df: DataFrame, key: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """``fold`` with exactly ceil(share x rows) test rows: those whose unique key has the lowest seeded hash.

    The hash's bound comes from counts; only the rows of one narrow range at the bound are ranked, and nothing else moves.
    """
    wanted = -int(-test_share * df.count() // 1)
    rows = df.select("*", F.lit(0).alias("_g"), priority(F.md5(F.concat(F.lit(f"{seed}:"), df[key].cast("string")))).alias("_h"))
    inside, outside = split_lowest(rows, {0: wanted}, [key], "_g", "_h")
    return inside.withColumn("fold", F.lit("test")).unionByName(outside.withColumn("fold", F.lit("train"))).drop("_g", "_h")


def leakage(df: DataFrame, text: str, fold: str) -> DataFrame:
    """One row: test rows, and those whose exact text is in training as well."""
    by_text = df.groupBy(text).agg(F.count_if(F.col(fold) == "train").alias("n_train"), F.count_if(F.col(fold) == "test").alias("n_test"))
    return by_text.agg(F.coalesce(F.sum("n_test"), F.lit(0)).alias("test_rows"), F.coalesce(F.sum(F.when(F.col("n_train") > 0, F.col("n_test"))), F.lit(0)).alias("leaked_rows"))
