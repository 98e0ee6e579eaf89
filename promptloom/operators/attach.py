"""Join every row to its group's results without sending a large group to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A group of more rows than this is hot, unless that would make more than MOST_HOT groups hot: their keys are broadcast.
HOT_ROWS, MOST_HOT = 200_000, 10_000


def attach(rows: DataFrame, groups: DataFrame, keys: list[str], confirm: list[str], values: list[str], size: str = "n", hot_rows: int = HOT_ROWS, spread: list[str] | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """``rows`` with the ``values`` of their group, inner; a key may have several groups.

    ``size`` is the number of rows of the group's key; ``sizes`` has it for each key, if ``groups`` is costly to read twice. A hot key's rows are dealt by the ``spread`` columns (all, if none are named) to as many parts as
    it holds ``hot_rows``, and its groups go to each part. Only the keys of hot groups are broadcast, at most MOST_HOT of
    them, since no more groups can be that large. ``confirm`` columns are compared as well and then dropped. Null keys
    match nothing.
    """
    on = [*keys, *confirm]
    slim = [c for c in rows.columns if c not in confirm]
    sizes = (groups if sizes is None else sizes).select(*keys, size).distinct()
    known = sizes.agg(F.sum(size).alias("total"), F.max(size).alias("top")).first()
    limit = max(hot_rows, (known.total or 0) // MOST_HOT)
    groups = groups.select(*on, *values, F.col(size).alias("_size"))
    if (known.top or 0) <= limit:
        return rows.join(groups, on).select(*slim, *values)
    hot = sizes.filter(F.col(size) > limit).select(*keys, F.ceil(F.col(size) / limit).cast("int").alias("_parts"))
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(*(spread or slim)), F.col("_parts")), F.lit(0)).cast("int"))
    spare = groups.withColumn("_part", F.explode(F.sequence(F.lit(0), F.when(F.col("_size") > limit, F.ceil(F.col("_size") / limit).cast("int") - 1).otherwise(0))))
    return dealt.join(spare, [*on, "_part"]).select(*slim, *values)
