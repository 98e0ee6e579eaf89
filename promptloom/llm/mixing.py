"""Problem 7: sources mixed to target shares of the total size.

Soft-membership mixing: a classifier over the labelled rows gives every row that names no source its posterior probabilities of the
sources; a row that names one is certain of it. Projected-gradient least squares fits a nonnegative rate for every row, at most the
allowed repeats, so that the expected sizes by source are the targets. A step needs one number for each source, which the
partitions of the rows add up; a row's rate follows from its posteriors and the steps, so that none is ever stored or sent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptloom.functions import text as core_text
from promptloom.llm import arrowtext as at
from promptloom.storage import written

#: Hashed words of the classifier: with the sources they bound what is collected.
BUCKETS = 4096
#: Steps of the gradient at most, and the change of the sizes, as a part of the total, at which they end.
STEPS, STILL = 40, 1e-5


def _features(text: Column) -> Column:
    words = F.split(F.trim(F.regexp_replace(F.lower(text), rf"[\p{{P}}{core_text.BLANKS[1:-1]}]+", " ")), " ")
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))


def classifier(rows: DataFrame, names: list[str]) -> np.ndarray:
    """Log probabilities [bucket + 1, source] of naive Bayes over the words of all rows with a known source; the last row is the prior.

    ``rows`` has ``text`` and ``source``. Counted by one aggregation; at most (BUCKETS + 1) x sources numbers come back. Each row
    counts once in the last bucket.
    """
    known = rows.filter(F.col("source").isin(names))
    got = known.select("source", F.explode(F.array_append(_features(F.col("text")), F.lit(BUCKETS))).alias("b")).groupBy("source", "b").agg(F.count(F.lit(1)).alias("n")).collect()
    number = {s: k for k, s in enumerate(names)}
    counts = np.full((BUCKETS + 1, len(names)), 0.5)
    counts[BUCKETS] = 1e-9
    for r in got:
        counts[r.b, number[r.source]] += r.n
    words, docs = counts[:BUCKETS], counts[BUCKETS]
    return np.vstack([np.log(words / words.sum(axis=0)), np.log(docs / docs.sum())])


def _posteriors(matrix: np.ndarray, flat: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The posteriors of many rows at once, from their words' buckets, flat."""
    score = np.tile(matrix[-1], (len(offs) - 1, 1))
    some = np.flatnonzero(np.diff(offs))
    if len(some):
        score[some] += np.add.reduceat(matrix[flat], offs[:-1][some], axis=0)
    p = np.exp(score - score.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def posteriors(matrix: np.ndarray, features: Column) -> Column:
    """Posterior probabilities of the sources; null for null."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def run(arr: pa.Array) -> pa.Array:
        there = arr.drop_null()
        lens = np.diff(there.offsets.to_numpy()) if len(there) else np.zeros(0, np.int64)
        p = _posteriors(matrix, there.flatten().to_numpy(zero_copy_only=False).astype(np.int64), at.offsets(lens))
        sizes = np.where(np.asarray(arr.is_valid()), matrix.shape[1], 0)
        mask = None if not arr.null_count else pa.array(np.asarray(arr.is_null()))
        return pa.ListArray.from_arrays(pa.array(at.offsets(sizes).astype(np.int32)), pa.array(p.ravel()), mask=mask)

    return run(features)


def rates(p: np.ndarray, steps: list[np.ndarray], most: float, start: float) -> np.ndarray:
    """The rate of rows of these posteriors after the steps, each projected to [0, most]."""
    rate = np.full(len(p), min(start, most))
    for g in steps:
        rate = np.clip(rate - p @ g, 0.0, most)
    return rate


def _matrix_of(arr: pa.Array, k: int) -> np.ndarray:
    return arr.flatten().to_numpy(zero_copy_only=False).reshape(-1, k)


def _sizes_by_source(soft: DataFrame, k: int, steps: list[np.ndarray], most: float, start: float) -> np.ndarray:
    """Expected sizes by source of the rows without one: a sum in each partition, and the sum of those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k)
        for batch in batches:
            p = _matrix_of(batch.column(1), k)
            total += (batch.column(0).to_numpy(zero_copy_only=False) * rates(p, steps, most, start)) @ p
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total.tolist()], [f"s{j}" for j in range(k)])

    sums = soft.select("size", "posterior").mapInArrow(run, T.StructType([T.StructField(f"s{j}", T.DoubleType()) for j in range(k)]))
    return np.array([x or 0.0 for x in sums.agg(*(F.sum(c).alias(c) for c in sums.columns)).first()])


class Mix:
    """The members (``id, source, size, k, posterior``), the targets, and what the rates follow from."""

    def __init__(self, members: DataFrame, names: list[str], shares: list[float], repeats: list[int], total: float):
        self.members, self.names, self.shares, self.repeats, self.total = members, names, shares, repeats, total
        self.steps: list[np.ndarray] = []
        self.start = 0.0

    @property
    def most(self) -> float:
        """A row without a source is used no more often than any source allows."""
        return float(min(self.repeats, default=0))

    def named_rates(self) -> np.ndarray:
        one = np.eye(len(self.names))
        return np.array([rates(one[j : j + 1], self.steps, float(n), self.start)[0] for j, n in enumerate(self.repeats)])


def members(rows: DataFrame, names: list[str], matrix: np.ndarray) -> DataFrame:
    """``id, source, size``; ``k``, the number of the source that the row names, null without a target; ``posterior``, only of rows that name none."""
    k = F.try_element_at(F.create_map(*(F.lit(x) for j, name in enumerate(names) for x in (name, j))), F.col("source"))
    unnamed = F.when(F.col("source").isNull(), _features(F.col("text")))
    return rows.select("id", "source", "size", k.alias("k"), posteriors(matrix, unnamed).alias("posterior"))


def rows_of(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """``id, text, source, size`` of the rows that can be mixed: those with a text that is not blank."""
    rows = df.select(df[key].alias("id"), df[text].alias("text"), core_text.clean_name(df[source]).alias("source"))
    return rows.filter(core_text.not_blank(F.col("text"))).withColumn("size", F.length("text").cast("bigint"))


def fit(df: DataFrame, key: str, text: str, source: str, weights: DataFrame, fraction: float) -> Mix:
    """Rates for a mix of ``fraction`` of the corpus's total text length. ``weights`` is a small table: source, target_share, max_repeats.

    Two scans: the classifier's counts, and the members, which are written without their texts. The objective is the distance of the
    sizes from the targets in the metric of the members' own spread over the sources, so that a step of one reaches the targets where no
    bound is in the way.
    """
    wanted = sorted((r for r in weights.collect() if r.source is not None), key=lambda r: r.source)
    names = [r.source for r in wanted]
    rows = rows_of(df, key, text, source)
    all_ = written(members(rows, names, classifier(rows, names)), "members") if names else written(rows.select("id", "source", "size", F.lit(None).cast("int").alias("k"), F.lit(None).cast("array<double>").alias("posterior")), "members")
    soft = all_.filter("posterior is not null")
    n = len(names)
    products = [F.sum(F.col("size") * F.col("posterior")[i] * F.col("posterior")[j]) for i in range(n) for j in range(n)]
    found = all_.groupBy("k").agg(F.sum("size").alias("size"), F.count("posterior").alias("soft"), F.array(*products).alias("spread")).collect() if n else []
    named = np.array([sum(float(r["size"]) for r in found if r.k == j) for j in range(n)])
    some = [r for r in found if r.k is None and r.soft]
    spread = np.diag(named) + (np.array(some[0].spread, np.float64).reshape(n, n) if some else 0.0)
    total = fraction * float(sum(r["size"] for r in found))
    mix_ = Mix(all_, names, [float(r.target_share or 0) for r in wanted], [int(r.max_repeats or 0) for r in wanted], total)
    target = np.array(mix_.shares) * total
    mix_.start = fraction
    metric = np.linalg.pinv(spread, rcond=1e-9) if n else spread
    before = None
    for _ in range(STEPS if n and total else 0):
        sizes = mix_.named_rates() * named + (_sizes_by_source(soft, n, mix_.steps, mix_.most, mix_.start) if some else 0.0)
        if before is not None and np.abs(sizes - before).max() <= STILL * total:
            break
        before = sizes
        mix_.steps.append(metric @ (sizes - target))
    return mix_


def mix(fitted: Mix, seed: int = 7) -> DataFrame:
    """``id, source, size, n_uses, k, posterior``: each row that is used, with its number of uses. Its expectation is the rate; no use exceeds the allowed repeats.

    Null and blank texts and rows of sources without a target are not used. A row without a source is used at the rate that
    follows from its posteriors, and its source stays null.
    """
    n, steps, most, start = len(fitted.names), fitted.steps, fitted.most, fitted.start

    @F.arrow_udf(T.DoubleType())
    def soft_rate(arr: pa.Array) -> pa.Array:
        out = np.zeros(len(arr))
        valid = np.asarray(arr.is_valid())
        out[valid] = rates(_matrix_of(arr.drop_null(), n), steps, most, start)
        return pa.array(out)

    named = F.element_at(F.array(*(F.lit(float(x)) for x in fitted.named_rates()), F.lit(0.0)), F.coalesce(F.col("k"), F.lit(n)) + 1)
    rows = fitted.members.filter("k is not null or posterior is not null")
    rows = rows.withColumn("rate", F.when(F.col("k").isNotNull(), named).otherwise(soft_rate("posterior") if n else F.lit(0.0)))
    chance = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id"), 11) / F.lit(float(1 << 53))
    uses = (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("int")).cast("int")
    return rows.select("id", "source", "size", uses.alias("n_uses"), "k", "posterior").filter("n_uses > 0")


def report(fitted: Mix, mixed: DataFrame) -> DataFrame:
    """For each source: target, rows and size there are, rows and uses in the mix, its size, actual share and whether the target was met.

    A source's size is that of the rows that name it and of what rows without a source are likely to hold of it, by
    their posteriors.
    """
    zero = F.lit(0).cast("bigint")
    size = F.col("size") * F.col("n_uses")
    certain = mixed.filter("k is not null").groupBy("k").agg(F.sum(size).cast("double").alias("mixed_size"), F.count(F.lit(1)).alias("n_rows_used"), F.sum("n_uses").alias("n_uses"))
    likely = mixed.filter("k is null").select(size.alias("size"), F.posexplode("posterior").alias("k", "p")).groupBy("k").agg(F.sum(F.col("size") * F.col("p")).alias("mixed_size"))
    got = certain.unionByName(likely.withColumns({"n_rows_used": zero, "n_uses": zero})).groupBy("k").agg(*(F.sum(c).alias(c) for c in ("mixed_size", "n_rows_used", "n_uses")))
    there = fitted.members.filter("k is not null").groupBy(F.col("k").alias("there")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("source_size"))
    targets = mixed.sparkSession.createDataFrame(list(zip(range(len(fitted.names)), fitted.names, fitted.shares, fitted.repeats)), "k int, source string, target_share double, max_repeats int")
    both = targets.join(got, "k", "left").join(there, F.col("k") == F.col("there"), "left")
    goal = F.col("target_share") * fitted.total
    status = F.when(F.col("n_rows").isNull(), "no rows").when(F.abs(F.coalesce("mixed_size", F.lit(0.0)) - goal) <= 0.05 * goal, "met").otherwise("not met")
    actual = F.coalesce(F.try_divide(F.col("mixed_size"), F.sum("mixed_size").over(W.partitionBy())), F.lit(0.0))
    return both.select(
        "source", F.round("target_share", 6).alias("target_share"), "max_repeats", F.coalesce("n_rows", zero).alias("n_rows"), F.coalesce("source_size", zero).alias("source_size"),
        F.coalesce("n_rows_used", zero).alias("n_rows_used"), F.coalesce("n_uses", zero).alias("n_uses"), F.round(F.coalesce("mixed_size", F.lit(0.0)), 3).alias("mixed_size"),
        F.round(actual, 6).alias("actual_share"), status.alias("status"),
    )
