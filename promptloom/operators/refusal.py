"""Refusal rows for unsafe prompts, and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptloom.functions import hashing, text
from promptloom.operators.corpus import percent
from promptloom.operators.position import with_running


def is_unsafe(label: Column) -> Column:
    """The label is ``unsafe`` in whatever letter case; a missing label is not."""
    return F.lower(text.default(label, "unknown")) == "unsafe"


def with_template(templates: list[str], custom: str | None = None) -> list[str]:
    """The templates, and the custom one unless it is among them."""
    return [*templates, custom] if custom is not None and custom not in templates else list(templates)


def unsafe_prompts(df: DataFrame, order: list[str], own_id: str | None = None) -> DataFrame:
    """Rows with a prompt (white space counts) and an unsafe label, with their position ``pos`` among **all** rows, from 0, their number ``k`` among
    the unsafe ones, from 1, and an id: their own, or ``ref_`` and the position in at least four digits.

    One numbering pass; of rows that are not unsafe only the order columns go along.
    """
    wanted = F.coalesce((df["prompt"] != "") & is_unsafe(df["label"]), F.lit(False))
    slim = df.select(*(F.when(wanted, F.col(c)).alias(c) if c not in order else F.col(c) for c in df.columns), wanted.alias("_unsafe"))
    rows = with_running(slim, [F.col(c).asc_nulls_first() for c in order], {"k": F.col("_unsafe").cast("int")}, "pos").filter("_unsafe")
    made = F.format_string("ref_%04d", F.col("pos"))
    return rows.withColumn("id", F.coalesce(F.col(own_id).cast("string"), made) if own_id else made).drop("_unsafe")


def refusals(df: DataFrame, order: list[str], templates: list[str], mode: str = "round_robin", own_id: str | None = None) -> DataFrame:
    """One refusal row for each unsafe prompt.

    ``round_robin``: the k-th unsafe row (from 1) gets template k modulo their number. ``hashed``: the template of the id's hash, a
    draw that can be repeated. ``random``: any template. Only round robin fills ``template_index``, with the first
    template of that text. The answer's label is always ``safe``; the prompt's label and source are kept as the original ones.
    """
    if not templates:
        raise ValueError("no templates")
    n = len(templates)
    needed = {*order, "prompt", "label", "source", *([own_id] if own_id else [])}
    rows = unsafe_prompts(df.select(*(c for c in df.columns if c in needed)), order, own_id)
    if mode == "round_robin":
        rows = rows.withColumn("t", F.pmod("k", F.lit(n)).cast("int"))
    elif mode == "hashed":
        rows = rows.withColumn("t", hashing.bucket(F.col("id"), n))
    elif mode == "random":
        rows = rows.withColumn("t", F.floor(F.rand() * n).cast("int"))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    first = F.array(*(F.lit(templates.index(t)) for t in templates))
    index = F.element_at(first, F.col("t") + 1) if mode == "round_robin" else F.lit(None)
    return rows.select(
        "id", "prompt", F.element_at(F.array(*map(F.lit, templates)), F.col("t") + 1).alias("refusal_response"), F.lit("safe").alias("label"), F.lit("template_generated").alias("source"),
        F.col("label").alias("original_label"), text.default(F.col("source"), "unknown").alias("original_source"), index.cast("int").alias("template_index"),
    )


def template_usage(rows: DataFrame) -> DataFrame:
    """Rows of each response and their percentage of all; a missing response is the empty text."""
    counts = rows.groupBy(text.default(F.col("refusal_response"), "").alias("refusal_response")).agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.count(F.lit(1)).alias("total")).scalar()
    return counts.select("refusal_response", "n", percent(F.col("n"), total).alias("percentage"))


def origin_counts(rows: DataFrame) -> DataFrame:
    """Rows by original label and by original source, in one pass: ``kind, value, n``."""
    named = rows.select(text.default(F.col("original_label"), "unknown").alias("l"), text.default(F.col("original_source"), "unknown").alias("s"))
    both = named.groupingSets([["l"], ["s"]], "l", "s").agg(F.count(F.lit(1)).alias("n"), F.grouping("l").alias("g"))
    return both.select(F.when(F.col("g") == 0, "original_label").otherwise("original_source").alias("kind"), F.when(F.col("g") == 0, F.col("l")).otherwise(F.col("s")).alias("value"), "n")


def length_statistics(rows: DataFrame) -> DataFrame:
    """One row: items, distinct responses, and least, most and mean length (code points) of prompts and responses. A null text has length 0; an empty table gives zero items and nulls."""
    prompt, answer = (F.length(text.default(F.col(c), "")) for c in ("prompt", "refusal_response"))
    parts = [f(x).alias(f"{name}_{f.__name__}") for name, x in (("prompt", prompt), ("response", answer)) for f in (F.min, F.max)]
    means = [F.round(F.avg(x), 6).alias(f"{name}_avg") for name, x in (("prompt", prompt), ("response", answer))]
    return rows.agg(F.count(F.lit(1)).alias("total_items"), F.count_distinct(text.default(F.col("refusal_response"), "")).alias("unique_templates_used"), *parts, *means)
