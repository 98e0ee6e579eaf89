"""Chat batch files as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptloom.operators.corpus import chat_prompts


def chat_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """The corpus rows of batch files (``{"conversations": [...]}``) as they arrive."""
    schema = "conversations array<struct<prompt_bn:string,prompt_safety:string>>"
    rows = spark.readStream.schema(schema).option("multiLine", True).option("maxFilesPerTrigger", files_per_trigger).json(folder)
    items = rows.select(F.col("_metadata.file_path").alias("batch_file"), F.posexplode("conversations").alias("pos", "c"))
    return chat_prompts(items.select("batch_file", "pos", "c.prompt_bn", "c.prompt_safety"))


def label_counts(stream: DataFrame) -> DataFrame:
    """Running number of prompts of each label; the state is one number for each label."""
    return stream.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
