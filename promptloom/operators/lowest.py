"""The rows of lowest priority of each group, however many: bounds from counts, no ranking of a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bits of a priority, and of one level of counts: each level narrows the bound to a 4096th.
BITS, STEP = 48, 12
#: A range of priorities of no more rows than this is ranked as it is.
SMALL = 20_000


def priority(hex_digest: Column) -> Column:
    """The first 48 bits of a hexadecimal digest."""
    return F.conv(F.substring(hex_digest, 1, BITS // 4), 16, 10).cast("bigint")


def bounds(rows: DataFrame, wanted: dict[int, int], group: str = "g", by: str = "priority") -> dict[int, tuple[int, int, int]]:
    """For each group (low, high, rest): rows below ``low`` are in, and the ``rest`` first of those from ``low`` to below ``high``.

    Every level counts the rows of one range of each group in 4096 parts; at most groups x 4096 counts are collected.
    """
    out = {g: (0, 1 << BITS, n) for g, n in wanted.items()}
    open_ = set(wanted)
    for level in range(BITS // STEP):
        width = BITS - STEP * (level + 1)
        inside = F.lit(False)
        for g in open_:
            inside = inside | ((F.col(group) == g) & (F.col(by) >= out[g][0]) & (F.col(by) < out[g][1]))
        cells: dict[int, list[tuple[int, int]]] = {g: [] for g in open_}
        counted = rows.filter(inside).groupBy(group, F.shiftright(by, width).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
        for r in counted.collect():
            cells[r[group]].append((r.cell, r.n))
        for g in list(open_):
            low, high, rest = out[g]
            if sum(n for _, n in cells[g]) <= rest:  # all of them
                out[g] = (high, high, 0)
                open_.remove(g)
                continue
            for cell, n in sorted(cells[g]):
                if n > rest:
                    out[g] = (cell << width, (cell + 1) << width, rest)
                    if rest == 0 or n <= SMALL or width == 0:
                        open_.remove(g)
                    break
                rest -= n
        if not open_:
            break
    return out


def split_lowest(rows: DataFrame, wanted: dict[int, int], tie: list[str], group: str = "g", by: str = "priority") -> tuple[DataFrame, DataFrame]:
    """The ``wanted`` rows of lowest priority of each group, and all other rows of these groups. Ties go by the ``tie`` columns."""
    found = [(g, *b) for g, b in bounds(rows, wanted, group, by).items()]
    frame = rows.sparkSession.createDataFrame(found, f"{group} int, _low bigint, _high bigint, _rest bigint")
    met = rows.join(F.broadcast(frame), group)
    rank = F.row_number().over(W.partitionBy(group).orderBy(by, *tie))
    edge = met.filter((F.col(by) >= F.col("_low")) & (F.col(by) < F.col("_high"))).withColumn("_k", rank)
    drop = ("_low", "_high", "_rest")
    inside = met.filter(F.col(by) < F.col("_low")).drop(*drop).unionByName(edge.filter("_k <= _rest").drop(*drop, "_k"))
    outside = met.filter(F.col(by) >= F.col("_high")).drop(*drop).unionByName(edge.filter("_k > _rest").drop(*drop, "_k"))
    return inside, outside
