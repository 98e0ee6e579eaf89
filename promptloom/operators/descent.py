"""Limited-memory BFGS on the driver; the loss and its gradient are summed over sparse rows where they lie.

The steps are those of the optimiser behind Spark's ``MultilayerPerceptronClassifier``: ten corrections, a strong Wolfe line
search, a first trial step of length one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

Objective = Callable[[np.ndarray], tuple[float, np.ndarray]]

#: Features of rows handled at once; a longer single row is handled whole, alone.
SLICE_FEATURES = 1 << 18
CORRECTIONS, TOLERANCE, TRIALS = 10, 1e-6, 10
DECREASE, CURVATURE = 1e-4, 0.9


class _NoStep(Exception):
    pass


def _sums(weights: np.ndarray):
    """``n, loss, gradient`` summed over a partition of ``label, indices, values``; the last weight is the intercept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, loss, gradient = 0, 0.0, np.zeros(len(weights))
        for batch in batches:
            label, indices, values = (batch.column(c) for c in ("label", "indices", "values"))
            ends = np.cumsum(pc.list_value_length(indices).to_numpy(zero_copy_only=False), dtype=np.int64)
            a = 0
            while a < len(ends):
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SLICE_FEATURES, "right")))
                y = label.slice(a, b - a).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(b - a), np.diff(ends[a:b], prepend=ends[a - 1] if a else 0))
                at, x = (c.slice(a, b - a).flatten().to_numpy(zero_copy_only=False) for c in (indices, values))
                margin = np.bincount(row, x * weights[at], minlength=b - a) + weights[-1]
                miss = np.exp(-np.logaddexp(0.0, -margin)) - y
                n += b - a
                loss += float((np.logaddexp(0.0, margin) - y * margin).sum())
                gradient[:-1] += np.bincount(at, x * miss[row], minlength=len(weights) - 1)
                gradient[-1] += miss.sum()
                a = b
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([loss]), pa.array([gradient], pa.list_(pa.float64()))], ["n", "loss", "gradient"])

    return run


def softmax_loss(rows: DataFrame) -> Objective:
    """The mean loss of a network without hidden layers on ``label`` (0/1), ``indices``, ``values``, and its gradient; weights in the order of
    Spark's network: both outputs of each feature, then both intercepts.

    Two outputs only matter by their difference. What reaches the driver is one gradient for each of twice the cluster's cores.
    """
    rows = rows.coalesce(2 * rows.sparkSession.sparkContext.defaultParallelism)
    signs = np.array([-1.0, 1.0])

    def at(weights: np.ndarray) -> tuple[float, np.ndarray]:
        parts = rows.mapInArrow(_sums(weights.reshape(-1, 2) @ signs), "n bigint, loss double, gradient array<double>").toArrow()
        n = pc.sum(parts["n"]).as_py()
        if not n:
            return float("nan"), np.zeros(len(weights))
        gradient = parts["gradient"].combine_chunks().flatten().to_numpy().reshape(len(parts), -1).sum(axis=0) / n
        return pc.sum(parts["loss"]).as_py() / n, np.outer(gradient, signs).ravel()

    return at


def _direction(gradient: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The gradient against the curvature that the last steps met."""
    q, shares = gradient.copy(), []
    for s, y in reversed(pairs):
        shares.append(s @ q / (s @ y))
        q -= shares[-1] * y
    if pairs:
        s, y = pairs[-1]
        q *= s @ y / (y @ y)
    for (s, y), share in zip(pairs, reversed(shares)):
        q += (share - y @ q / (s @ y)) * s
    return -q


def _between(low: tuple, high: tuple) -> float:
    """Where the cubic through two points and their slopes is least, a tenth of the way from either at least."""
    (t0, f0, s0), (t1, f1, s1) = sorted((low[:3], high[:3]))
    d1 = s0 + s1 - 3 * (f0 - f1) / (t0 - t1)
    with np.errstate(invalid="ignore", divide="ignore"):
        d2 = np.sqrt(np.float64(d1 * d1 - s0 * s1))
        t = t1 - (t1 - t0) * (s1 + d2 - d1) / (s1 - s0 + 2 * d2)
    middle = (t0 + t1) / 2
    return float(min(max(t if np.isfinite(t) else middle, t0 + 0.1 * (t1 - t0)), t0 + 0.9 * (t1 - t0)))


def _search(objective: Objective, x: np.ndarray, value: float, gradient: np.ndarray, direction: np.ndarray, t: float) -> tuple[np.ndarray, float, np.ndarray]:
    """The point, value and gradient of a step that satisfies the strong Wolfe conditions."""
    slope = float(gradient @ direction)

    def trial(t: float) -> tuple:
        point = x + t * direction
        found, g = objective(point)
        return t, found, float(g @ direction), point, g

    def too_high(c: tuple) -> bool:
        return c[1] > value + DECREASE * c[0] * slope

    low, high = (0.0, value, slope), None
    for k in range(TRIALS):
        c = trial(t)
        if not np.isfinite(c[1]):
            t /= 2
            continue
        if too_high(c) or (k and c[1] >= low[1]):
            high = c
            break
        if abs(c[2]) <= CURVATURE * abs(slope):
            return c[3], c[1], c[4]
        if c[2] >= 0:
            low, high = c, low
            break
        low, t = c, 1.5 * t
    for _ in range(TRIALS if high is not None else 0):
        c = trial(_between(low, high))
        if too_high(c) or c[1] >= low[1]:
            high = c
            continue
        if abs(c[2]) <= CURVATURE * abs(slope):
            return c[3], c[1], c[4]
        if c[2] * (high[0] - low[0]) >= 0:
            high = low
        low = c
    raise _NoStep


def minimise(objective: Objective, x: np.ndarray, steps: int) -> tuple[np.ndarray, list[float]]:
    """The weights after at most so many steps, and the loss at the start and after each. A search that fails is repeated once along the gradient."""
    value, gradient = objective(x)
    values, pairs, failed = [value], [], False
    while len(values) <= steps and np.linalg.norm(gradient) > max(TOLERANCE * value, 1e-8):
        if len(values) > 1 and abs(value - max(values[-CORRECTIONS:])) <= TOLERANCE * abs(values[0]):
            break
        direction = _direction(gradient, pairs)
        try:
            found = _search(objective, x, value, gradient, direction, 1.0 if pairs else 1 / np.linalg.norm(direction))
        except _NoStep:
            if failed:
                break
            failed, pairs = True, []
            continue
        pairs = [*pairs, (found[0] - x, found[2] - gradient)][-CORRECTIONS:]
        x, value, gradient = found
        values.append(value)
    return x, values
