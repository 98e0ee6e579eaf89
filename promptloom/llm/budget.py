"""Problem 3: how many tokens each slice of the corpus holds, counted without making them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptloom.llm import arrowtext as at
from promptloom.llm import bpe, trie


def token_count(text: Column, tokenizer: str = "piece_bpe_32k", folder: str = bpe.TOKENIZER_DIR) -> Column:
    """Tokens of a text, without special tokens; 0 for null and empty. Byte vocabularies have no normalised
    segments for the trie: their counts come from the merges."""

    @F.arrow_udf(T.LongType())
    def run(arr: pa.Array) -> pa.Array:
        tok = trie.load(tokenizer, folder) if tokenizer.startswith("piece") else bpe.load(tokenizer, folder)
        parts = [tok.count(*at.to_codepoints(arr.slice(a, b - a))) for a, b in at.slices(arr)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64))

    return run(text)


def budget(df: DataFrame, text: str, slices: dict[str, Column], tokenizer: str = "piece_bpe_32k", folder: str = bpe.TOKENIZER_DIR) -> DataFrame:
    """One row for each combination of the slices, for each value of each slice, and for the whole.

    Columns: the slices (``(all)`` where a row adds up over them, ``unknown`` for null), ``n_rows``, ``n_texts`` (not null), and
    ``n_tokens``. Every row counts, repeats too. Each task adds up its rows before the shuffle, which moves one row for
    each combination; the totals come from the combinations. An empty table gives no rows.
    """
    names = list(slices)
    rows = df.select(*(F.coalesce(c.cast("string"), F.lit("unknown")).alias(n) for n, c in slices.items()), df[text].alias("_text"))
    rows = rows.withColumn("_tokens", token_count(F.col("_text"), tokenizer, folder))
    cells = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n_rows"), F.count("_text").alias("n_texts"), F.sum("_tokens").alias("n_tokens"))
    kept = dict.fromkeys([tuple(names), *((n,) for n in names), ()])  # of a single slice the combination and the value are the same
    sets = F.array(*(F.array(*(F.col(m) if m in some else F.lit("(all)") for m in names)) for some in kept))
    spread = cells.select(F.explode(sets).alias("k"), "n_rows", "n_texts", "n_tokens")
    return spread.groupBy(*(F.col("k")[i].alias(n) for i, n in enumerate(names))).agg(*(F.sum(c).alias(c) for c in ("n_rows", "n_texts", "n_tokens")))
