"""Problem 8: the whole corpus as token ids of a public tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from promptloom.llm import arrowtext as at
from promptloom.llm import bpe


def encode(df: DataFrame, key: str, text: str, tokenizer: str = "byte_bpe_50k", folder: str = bpe.TOKENIZER_DIR) -> DataFrame:
    """``key`` and ``ids``: one row for each row of ``df``, without special tokens.

    Null and empty texts give an empty list; strings that look like special tokens are ordinary text;
    repeated rows are kept. Other columns of ``df`` are not read. There is no shuffle: each task encodes
    the texts that it scans, in slices of bounded size, a longer single text whole.
    """
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = bpe.load(tokenizer, folder)
        for batch in batches:
            for a, b in at.slices(batch.column(1)):
                ids, offs = tok.encode(*at.to_codepoints(batch.column(1).slice(a, b - a)))
                lists = pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], ["key", "ids"])

    schema = T.StructType([T.StructField("key", kind), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])
    return df.select(df[key].alias("key"), df[text].alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)
