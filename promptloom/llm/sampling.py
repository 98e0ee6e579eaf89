"""Problem 4: a sample whose categories have given shares.

Each row has a random priority, by the hash of its key. One pass over the rows keeps, in every task, a reservoir for each
category: the rows of lowest priority, of bounded number, how many rows there were, and below which priority none is missing.
Reservoirs merge by putting them together and taking the lowest such bound; merged they stay distributed, however large. The final
counts give feasible quotas, and each category's reservoir is trimmed to its quota.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptloom.operators.lowest import priority, split_lowest
from promptloom.storage import written

#: Rows that a task keeps of each category. Where the merged reservoir proves too small for a quota, the category is read again in full.
RESERVOIR = 1 << 16
#: A target is met if the actual share is off by at most this part of it: minima and exhausted categories move the others.
TOLERANCE = 0.02


class _Reservoir:
    """The rows of lowest priority of one category in one task."""

    def __init__(self, most: int):
        self.most, self.n, self.limit, self.kept = most, 0, None, []

    def add(self, rows: pa.Table) -> None:
        self.n += rows.num_rows
        self.kept.append(rows)
        if sum(t.num_rows for t in self.kept) > 2 * self.most:
            self.trim()

    def trim(self) -> pa.Table:
        rows = pa.concat_tables(self.kept)
        if rows.num_rows > self.most:
            rows = rows.take(pc.sort_indices(rows, [("priority", "ascending"), ("id", "ascending")])).combine_chunks()
            self.limit = rows.column("priority")[self.most].as_py()  # the lowest that is left out, now the highest that counts
            rows = rows.slice(0, self.most)
        self.kept = [rows]
        return rows


def _reservoirs(most: int) -> Callable:
    """``g, id, priority`` of the rows kept; and for each category a row with their number ``n`` and the bound ``limit``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, _Reservoir] = {}
        others, schema = 0, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            schema = table.schema
            for g in pc.unique(table.column("g")).to_pylist():
                mine = table.filter(pc.equal(table.column("g"), g))
                if g < 0:
                    others += mine.num_rows
                else:
                    own.setdefault(g, _Reservoir(most)).add(mine)
        if schema is None:
            return
        kind = schema.field("id").type
        names = ["g", "id", "priority", "n", "limit"]
        for reservoir in own.values():
            rows = reservoir.trim()
            none = pa.nulls(rows.num_rows, pa.int64())
            yield from pa.table([*(rows.column(c) for c in names[:3]), none, none], names).to_batches()
        counts = [(-1, others, None), *((g, r.n, r.limit) for g, r in own.items())]
        g, n, limit = zip(*counts)
        yield pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), pa.nulls(len(g), kind), pa.nulls(len(g), pa.int64()), pa.array(n, pa.int64()), pa.array(limit, pa.int64())], names)

    return run


def quotas(shares: list[float], least: list[int], available: list[int], size: int) -> list[int]:
    """Rows of each category, ``size`` of them together if there are as many.

    Minima come first (all in proportion, if they alone exceed the size). The rest goes to the categories in proportion to their
    shares, none above what there is; what exhausted categories leave goes to the others in the same way. Whole numbers by largest remainders.
    """
    low = [min(m, a) for m, a in zip(least, available)]
    goal = min(size, sum(a if s > 0 else m for s, m, a in zip(shares, low, available)))
    if sum(low) >= goal:
        exact = [m * goal / max(1, sum(low)) for m in low]
    else:
        level = 0.0

        def at(x: float) -> list[float]:
            return [max(m, min(a, x * s)) for s, m, a in zip(shares, low, available)]

        for b in sorted(x / s for s, m, a in zip(shares, low, available) if s > 0 for x in (m, a)):
            if sum(at(b)) <= goal + 1e-9:
                level = b
        growing = sum(s for s, m, a in zip(shares, low, available) if s > 0 and m / s <= level < a / s)
        exact = at(level + (goal - sum(at(level))) / growing if growing else level)
    whole = [int(x + 1e-9) for x in exact]
    for k in sorted(range(len(shares)), key=lambda k: (-round(exact[k] - whole[k], 6), k))[: max(0, goal - sum(whole))]:
        whole[k] += 1
    return whole


class Plan:
    """The merged reservoirs, and on the driver one row for each target with its quota."""

    def __init__(self, state: DataFrame | None, rows: list[dict]):
        self.state, self.rows = state, rows


def _rows(df: DataFrame, key: str, label: Column, source: Column, wanted: list, seed: int) -> DataFrame:
    """``g`` (the target's number, -1 for none), ``id`` and ``priority``."""
    # one look-up, so that label and source are worked out once a row
    table = F.create_map(*(F.lit(x) for k, r in enumerate(wanted) for x in (f"{r['label']}\n{r['source']}", k))) if wanted else F.create_map(F.lit(""), F.lit(-1))
    number = F.when(df[key].isNotNull(), F.try_element_at(table, F.concat(label, F.lit("\n"), source)))
    return df.select(F.coalesce(number, F.lit(-1)).cast("int").alias("g"), df[key].alias("id"), priority(F.md5(F.concat(F.lit(f"{seed}:"), df[key].cast("string")))).alias("priority"))


def plan(df: DataFrame, key: str, label: Column, source: Column, targets: DataFrame, fraction: float, seed: int = 0, reservoir: int | None = None) -> Plan:
    """One pass over the rows for the reservoirs; then the quotas. ``targets`` is a small table: label, source, target_share, min_rows; rows
    without a label or source or with a negative share are no targets."""
    wanted = [{"label": r.label, "source": r.source, "target_share": float(r.target_share or 0), "min_rows": int(r.min_rows or 0)} for r in targets.select("label", "source", "target_share", "min_rows").collect() if r.label is not None and r.source is not None and (r.target_share or 0) >= 0]
    wanted.sort(key=lambda r: (r["label"], r["source"]))
    rows = _rows(df, key, label, source, wanted, seed)
    schema = T.StructType([T.StructField("g", T.IntegerType()), T.StructField("id", df.schema[key].dataType), *(T.StructField(c, T.LongType()) for c in ("priority", "n", "limit"))])
    state = written(rows.mapInArrow(_reservoirs(reservoir or RESERVOIR), schema), "reservoirs")
    merged = {r.g: r for r in state.filter("n is not null").groupBy("g").agg(F.sum("n").alias("n"), F.min("limit").alias("limit")).collect()}
    total = sum(r.n for r in merged.values())
    for k, r in enumerate(wanted):
        r["available"], r["limit"] = (merged[k].n, merged[k].limit) if k in merged else (0, None)
    got = quotas([r["target_share"] for r in wanted], [r["min_rows"] for r in wanted], [r["available"] for r in wanted], int(fraction * total + 0.5))
    for r, quota in zip(wanted, got):
        r["quota"] = quota
    return Plan(state, wanted)


def sample(df: DataFrame, key: str, label: Column, source: Column, plan_: Plan, seed: int = 0) -> DataFrame:
    """``id, label, source``: exactly the quota of each category, each of its rows as likely as any other, without repeats.

    Rows of other categories and rows with a null key, label or source are not drawn. Ties of priority are broken by the key. The
    rows come from the reservoirs; a category whose quota goes beyond what they hold in full is taken from ``df`` itself.
    """
    kept = plan_.state.filter("n is null").select("g", "id", "priority")
    cut = {k: r["limit"] for k, r in enumerate(plan_.rows) if r["limit"] is not None}
    if cut:
        whole = F.lit(True)
        for k, limit in cut.items():
            whole = F.when(F.col("g") == k, F.col("priority") < limit).otherwise(whole)
        kept = kept.filter(whole)
        held = {r.g: r.n for r in kept.filter(F.col("g").isin(list(cut))).groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()}
        short = [k for k in cut if held.get(k, 0) < plan_.rows[k]["quota"]]
        if short:
            again = _rows(df, key, label, source, plan_.rows, seed).filter(F.col("g").isin(short))
            kept = kept.filter(~F.col("g").isin(short)).unionByName(again)
    inside, _ = split_lowest(kept, {k: r["quota"] for k, r in enumerate(plan_.rows)}, ["id"])
    names = (F.element_at(F.array(*(F.lit(r[c]) for r in plan_.rows)), F.col("g") + 1).alias(c) for c in ("label", "source"))
    return inside.select("id", *names) if plan_.rows else inside.select("id", F.lit("").alias("label"), F.lit("").alias("source"))


def report(plan_: Plan, spark) -> DataFrame:
    """Each target with what there is, its quota, the actual share, and whether that is the target's, within TOLERANCE (``met``).

    Else there are no rows, its rows are ``exhausted``, it was raised to the ``minimum``, or what other categories lack or have too much
    of leaves its share ``above`` or ``below`` the target.
    """
    size = sum(r["quota"] for r in plan_.rows)
    names = ("label", "source", "target_share", "min_rows", "available", "quota")
    df = spark.createDataFrame([tuple(r[k] for k in names) for r in plan_.rows], "label string, source string, target_share double, min_rows bigint, available bigint, quota bigint")
    actual = F.coalesce(F.try_divide(F.col("quota").cast("double"), F.lit(float(size))), F.lit(0.0))
    low, high = actual < F.col("target_share") * (1 - TOLERANCE), actual > F.col("target_share") * (1 + TOLERANCE)
    status = F.when(F.col("available") == 0, "no rows").when((F.col("quota") >= F.col("available")) & (low | (F.col("quota") < F.col("min_rows"))), "exhausted")
    status = status.when(high & (F.col("quota") == F.col("min_rows")), "minimum").when(high, "above").when(low, "below").otherwise("met")
    return df.select("label", "source", F.round("target_share", 6).alias("target_share"), "min_rows", "available", "quota", F.round(actual, 6).alias("actual_share"), status.alias("status"))
