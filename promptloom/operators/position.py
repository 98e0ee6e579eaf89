"""Dense row positions and running sums without a window over the whole table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptloom.storage import written


def _within_partition(names: list[str]):
    """Running sums of the named columns over a partition, in its order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = [0] * len(names)
        for batch in batches:
            at = [batch.schema.get_field_index(n) for n in names]
            columns = list(batch.columns)
            for i, k in enumerate(at):
                sums = before[i] + np.cumsum(columns[k].to_numpy(zero_copy_only=False), dtype=np.int64)
                before[i] = int(sums[-1]) if len(sums) else before[i]
                columns[k] = pa.array(sums, pa.int64())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return run


def with_running(df: DataFrame, order: list[Column], sums: dict[str, Column], name: str | None = None) -> DataFrame:
    """``df`` with the running sum of each of ``sums`` (whole numbers, a null counts as 0) up to and with the row, in the given order.

    ``name``: also the row's dense position, from 0. Rows are split into ranges and added up within each; one row for each
    range is all that is collected. One exchange, one write. The order must be total for a repeatable result.
    """
    slots = {f"_run_{k}": F.coalesce(c.cast("bigint"), F.lit(0).cast("bigint")) for k, c in enumerate(sums.values())}
    # a number is named so that small ranges are not put together into one task
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.select("*", *(c.alias(s) for s, c in slots.items())).repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    if slots:
        schema = T.StructType([f if f.name not in slots else T.StructField(f.name, T.LongType()) for f in ranged.schema.fields])
        ranged = ranged.mapInArrow(_within_partition(list(slots)), schema)
    parts = written(ranged, "ranges")
    # the upper bits number the partition, the lower 33 the row within it
    number, inside = F.shiftright("_at", 33).cast("int"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    totals = parts.groupBy(number.alias("_part")).agg(F.count(F.lit(1)).alias("n"), *(F.max(s).alias(s) for s in slots)).orderBy("_part").collect()
    before, shifts = [0] * (1 + len(slots)), []
    for r in totals:
        shifts.append((r["_part"], *before))
        before = [b + r[c] for b, c in zip(before, ("n", *slots))]
    schema = ", ".join(["_part int", "_shift bigint", *(f"_before{s} bigint" for s in slots)])
    out = parts.withColumn("_part", number).join(F.broadcast(df.sparkSession.createDataFrame(shifts, schema)), "_part")
    made = {n: F.col(s) + F.col(f"_before{s}") for n, s in zip(sums, slots)}
    if name is not None:
        made[name] = F.col("_shift") + inside
    return out.withColumns(made).drop("_part", "_shift", "_at", *slots, *(f"_before{s}" for s in slots))


def with_position(df: DataFrame, order: list[str], name: str = "pos", start: int = 0) -> DataFrame:
    """``df`` with 0, 1, 2, ... (or from ``start``) in the order of columns that together are unique. Nulls come first."""
    out = with_running(df, [F.col(c).asc_nulls_first() for c in order], {}, name)
    return out.withColumn(name, F.col(name) + start) if start else out
