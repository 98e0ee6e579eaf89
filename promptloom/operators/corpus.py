"""The labelled corpus: three sources brought to one shape, their union, and its statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptloom.functions import text

COLUMNS = ("src_ord", "file_ord", "pos", "prompt", "label", "source")


def collapsed_label(label: Column) -> Column:
    """``safe`` for exactly that word, ``unsafe`` for anything else; letter case matters."""
    return F.when(label == "safe", "safe").otherwise("unsafe")


def chat_prompts(items: DataFrame, src_ord: int = 0, source: str = "llamaguard") -> DataFrame:
    """Conversations (``batch_file, pos, prompt_bn, prompt_safety``) with a prompt and a label after stripping. A null is a missing field."""
    rows = items.select("batch_file", "pos", text.strip(F.col("prompt_bn")).alias("prompt"), text.strip(F.col("prompt_safety")).alias("label"))
    rows = rows.filter((F.col("prompt") != "") & (F.col("label") != ""))
    return rows.select(
        F.lit(src_ord).alias("src_ord"), F.col("batch_file").alias("file_ord"), F.col("pos").cast("bigint").alias("pos"), "prompt", collapsed_label(F.col("label")).alias("label"), F.lit(source).alias("source")
    )


def listed_prompts(prompts: DataFrame, src_ord: int, source: str) -> DataFrame:
    """A prompt list (``id, prompt``), all of it unsafe; prompts that are empty after stripping are left out."""
    rows = prompts.select(F.col("id").cast("bigint").alias("pos"), text.strip(F.col("prompt")).alias("prompt")).filter(F.col("prompt") != "")
    return rows.select(F.lit(src_ord).alias("src_ord"), F.lit("").alias("file_ord"), "pos", "prompt", F.lit("unsafe").alias("label"), F.lit(source).alias("source"))


def combined(*parts: DataFrame) -> DataFrame:
    """The sources one after the other; nothing is deduplicated."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def percent(part: Column, whole: Column) -> Column:
    """Rounded to 6 places; 0 where there is nothing."""
    return F.round(F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0)), 6)


def statistics(rows: DataFrame) -> DataFrame:
    """One row: all, safe and unsafe prompts and their percentages, in one pass; zeros for an empty corpus."""
    counted = rows.agg(F.count(F.lit(1)).alias("total_prompts"), F.count_if(F.col("label") == "safe").alias("safe_prompts"), F.count_if(F.col("label") == "unsafe").alias("unsafe_prompts"))
    return counted.select("*", percent(F.col("safe_prompts"), F.col("total_prompts")).alias("safe_percentage"), percent(F.col("unsafe_prompts"), F.col("total_prompts")).alias("unsafe_percentage"))


def source_distribution(rows: DataFrame) -> DataFrame:
    """Prompts of each source; a null source is ``unknown``."""
    return rows.groupBy(text.default(F.col("source"), "unknown").alias("source")).agg(F.count(F.lit(1)).alias("n"))
