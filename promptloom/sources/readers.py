"""Files to DataFrames. All parsing is Spark's; a bad file costs its own rows only, unless said otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptloom.functions.text import default
from promptloom.operators import corpus as built
from promptloom.operators import flatten, trainlog

_BAD = "_corrupt_record"
_CHAT = f"conversations array<struct<prompt_bn:string,prompt_safety:string>>, {_BAD} string"
_LIST = f"prompts array<struct<id:string,prompt:string,category:string,sub_category:string>>, id string, prompt string, category string, sub_category string, {_BAD} string"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or a pattern names anything."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop)
    return found is not None and len(found) > 0


def prompt_csv(spark: SparkSession, path: str) -> DataFrame:
    """``text`` of a CSV file with one used column; the first row is always a header, quotes are doubled, an empty field is the empty text."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", True).csv(path, "text string")
    return rows.select(default(F.col("text"), "").alias("text"))


def nested_categories(spark: SparkSession, path: str) -> DataFrame:
    """One row for each prompt of a JSON object category -> sub-category -> prompts, with its places ``p1, p2, p3``."""
    whole = spark.read.text(path, wholetext=True)
    return flatten.nested_map(flatten.from_json_text(whole, "value"), "value")


def chat_batches(spark: SparkSession, pattern: str, ordered: bool = False) -> DataFrame:
    """``batch_file, pos, prompt_bn, prompt_safety`` of the conversations in batch files, which sort by name as text (10 before 2).

    A file that is not a JSON object with conversations is skipped; ``bad_batches`` names it. No file at all gives no rows.
    ``ordered``: rows come in the order of file name and place.
    """
    if not exists(spark, pattern):
        return spark.createDataFrame([], "batch_file string, pos int, prompt_bn string, prompt_safety string")
    rows = _batches(spark, pattern).filter(_GOOD)
    rows = rows.select("batch_file", F.posexplode("conversations").alias("pos", "c")).select("batch_file", "pos", "c.prompt_bn", "c.prompt_safety")
    return rows.orderBy(F.element_at(F.split("batch_file", "/"), -1), "batch_file", "pos") if ordered else rows


_GOOD = f"{_BAD} is null and conversations is not null"


def _batches(spark: SparkSession, pattern: str) -> DataFrame:
    # multiLine reads a whole file as one record, so a broken file is one corrupt record
    rows = spark.read.schema(_CHAT).option("multiLine", True).option("columnNameOfCorruptRecord", _BAD).json(pattern)
    return rows.select(F.col("_metadata.file_path").alias("batch_file"), "conversations", _BAD)


def bad_batches(spark: SparkSession, pattern: str) -> DataFrame:
    """``batch_file, message`` of the files that ``chat_batches`` skips, one row each."""
    if not exists(spark, pattern):
        return spark.createDataFrame([], "batch_file string, message string")
    rows = _batches(spark, pattern).filter(f"not ({_GOOD})").groupBy("batch_file").agg(F.count_if(F.col(_BAD).isNotNull()).alias("broken"))
    return rows.select("batch_file", F.when(F.col("broken") > 0, "no valid JSON object").otherwise("no conversations").alias("message"))


def corpus(spark: SparkSession, batches: str, multijail: str, catqa: str) -> DataFrame | None:
    """The labelled corpus of all files; ``None`` if no batch file is there, whatever the other lists hold. A missing list adds nothing."""
    if not exists(spark, batches):
        return None
    chat = chat_batches(spark, batches).withColumn("batch_file", F.element_at(F.split("batch_file", "/"), -1))
    lists = []
    for number, (path, source) in enumerate(((multijail, "multijail"), (catqa, "catqa")), 1):
        lists.append(built.listed_prompts(prompt_list(spark, path), number, source))
    return built.combined(built.chat_prompts(chat), *lists)


def prompt_list(spark: SparkSession, path: str) -> DataFrame:
    """``id, prompt, category, sub_category`` of a list, bare or under ``prompts``. A missing or broken file gives no rows."""
    if not exists(spark, path):
        return spark.createDataFrame([], "id string, prompt string, category string, sub_category string")
    rows = spark.read.schema(_LIST).option("multiLine", True).option("columnNameOfCorruptRecord", _BAD).json(path).filter(F.col(_BAD).isNull())
    bare = F.struct("id", "prompt", "category", "sub_category")
    inside = F.coalesce("prompts", F.when(F.coalesce("id", "prompt", "category", "sub_category").isNotNull(), F.array(bare)))
    return rows.select(F.inline(inside))


def records_or_conversations(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSON list, or of the ``conversations`` of a JSON object. Anything else, or a broken or missing file, is an error."""
    rows = spark.read.option("multiLine", True).option("mode", "FAILFAST").json(path)
    head = spark.read.text(path, wholetext=True).select(F.substring(F.ltrim(F.regexp_replace("value", r"^[\s\x{feff}]+", "")), 1, 1).alias("c")).first()
    if head is not None and head.c == "[":
        return rows
    if "conversations" in rows.columns:
        return rows.select(F.inline("conversations"))
    raise ValueError("expected a list of records or an object with 'conversations'")


def records(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSON list, with the union of their fields; a missing field is null."""
    return spark.read.option("multiLine", True).json(path)


def training_log(spark: SparkSession, path: str) -> DataFrame:
    """``epoch, train_loss, eval_loss`` of a training log."""
    return trainlog.epochs(spark.read.text(path, wholetext=True), "value")


def trained_models(spark: SparkSession, folder: str) -> list[str]:
    """Names of the folders that hold a finished model, sorted."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/*/final_model")
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop)
    return sorted(s.getPath().getParent().getName() for s in found or [])
