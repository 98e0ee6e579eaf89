"""Classification metrics for all models at once. Frames have ``model, y, yhat`` (0/1) and ``score``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptloom.operators.position import with_running
from promptloom.storage import written


def ratio(a: Column, b: Column) -> Column:
    """0 where undefined."""
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def threshold(score: Column, at: float = 0.5) -> Column:
    """1 for more than the threshold, 0 for no more; null for null."""
    return (score > at).cast("int")


def confusion(df: DataFrame) -> DataFrame:
    """``model, y, yhat, n``: all four cells of each model, zeros as well. Rows without truth or prediction are left out."""
    cells = df.filter("y is not null and yhat is not null").groupBy("model").agg(*(F.count_if((F.col("y") == a) & (F.col("yhat") == b)).alias(f"c{a}{b}") for a in (0, 1) for b in (0, 1)))
    grid = F.array(*(F.struct(F.lit(a).alias("y"), F.lit(b).alias("yhat"), F.col(f"c{a}{b}").alias("n")) for a in (0, 1) for b in (0, 1)))
    return cells.select("model", F.inline(grid))


def _cells(df: DataFrame) -> DataFrame:
    y, p = F.col("y"), F.col("yhat")
    kept = df.filter("y is not null and yhat is not null")
    return kept.groupBy("model").agg(*(F.count_if((y == a) & (p == b)).alias(n) for a, b, n in ((1, 1, "tp"), (0, 1, "fp"), (1, 0, "fn"), (0, 0, "tn"))))


def _ratios(cells: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return cells.select(
        "model", F.round(ratio(tp + tn, tp + fp + fn + tn), 6).alias("accuracy"), F.round(ratio(tp, tp + fp), 6).alias("precision"), F.round(ratio(tp, tp + fn), 6).alias("recall"),
        F.round(ratio(2 * tp, 2 * tp + fp + fn), 6).alias("f1"),
    )


def precision_recall_f1(df: DataFrame) -> DataFrame:
    """Of class 1, with accuracy; undefined ratios are 0."""
    return _ratios(_cells(df))


def class_report(df: DataFrame, names: tuple[str, str] = ("safe", "unsafe")) -> DataFrame:
    """``model, row, precision, recall, f1, support``: both classes, macro and weighted means; accuracy in all three of its row."""
    c = _cells(df)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    sides = ((tn, fn, fp), (tp, fp, fn))  # hits, wrongly given, missed
    one = [(ratio(h, h + w), ratio(h, h + m), ratio(2 * h, 2 * h + w + m), h + m) for h, w, m in sides]
    n = tp + fp + fn + tn
    rows = [(names[k], *one[k]) for k in (0, 1)]
    acc = ratio(tp + tn, n)
    rows.append(("accuracy", acc, acc, acc, n))
    rows.append(("macro avg", *((one[0][k] + one[1][k]) / 2 for k in range(3)), n))
    rows.append(("weighted avg", *(ratio(one[0][k] * one[0][3] + one[1][k] * one[1][3], n) for k in range(3)), n))
    grid = F.array(*(F.struct(F.lit(r[0]).alias("row"), *(F.round(x, 6).alias(a) for a, x in zip(("precision", "recall", "f1"), r[1:4])), r[4].alias("support")) for r in rows))
    return c.select("model", F.inline(grid))


def points(df: DataFrame) -> DataFrame:
    """Rows of like ``model, score, yhat``, collapsed to their numbers of positives and negatives: all that the metrics need."""
    kept = df.filter("y is not null").groupBy("model", "score", "yhat")
    return kept.agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("n"))


def _cumulative(made: DataFrame) -> DataFrame:
    """Counts at or above each distinct score, by running sums over ranges of scores, and of the model as a whole; ``p`` and ``n`` at the score."""
    distinct = made.filter("score is not null").groupBy("model", "score").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    run = with_running(distinct, [F.col("model").asc_nulls_first(), F.col("score").desc()], {"run_p": F.col("p"), "run_n": F.col("n")})
    whole = run.groupBy(F.col("model").alias("_m")).agg(
        F.min(F.col("run_p") - F.col("p")).alias("p0"), F.min(F.col("run_n") - F.col("n")).alias("n0"), F.sum("p").alias("pos"), F.sum("n").alias("neg")
    )
    met = run.join(whole, F.col("model").eqNullSafe(F.col("_m")))
    return met.select("model", "score", (F.col("run_p") - F.col("p0")).alias("tp"), (F.col("run_n") - F.col("n0")).alias("fp"), "p", "n", "pos", "neg")


def roc_points(df: DataFrame) -> DataFrame:
    """``model, threshold, fpr, tpr`` at each distinct score; the start (0, 0) is left out."""
    c = _cumulative(points(df))
    return c.select("model", F.col("score").alias("threshold"), F.round(ratio(F.col("fp"), F.col("neg")), 6).alias("fpr"), F.round(ratio(F.col("tp"), F.col("pos")), 6).alias("tpr"))


def pr_points(df: DataFrame) -> DataFrame:
    """``model, threshold, precision, recall`` at each distinct score; the start (recall 0, precision 1) is left out."""
    return _cumulative(points(df)).select(
        "model", F.col("score").alias("threshold"), F.round(ratio(F.col("tp"), F.col("tp") + F.col("fp")), 6).alias("precision"), F.round(ratio(F.col("tp"), F.col("pos")), 6).alias("recall")
    )


def areas(made: DataFrame) -> DataFrame:
    """``model, roc_auc, pr_auc``: trapezoids under both curves, from (0, 0) and from recall 0, precision 1. Each point knows the one before it
    from its own counts."""
    tp, fp, pos, neg = (F.col(c) for c in ("tp", "fp", "pos", "neg"))
    tp0, fp0 = tp - F.col("p"), fp - F.col("n")
    roc = (ratio(fp, neg) - ratio(fp0, neg)) * (ratio(tp, pos) + ratio(tp0, pos)) / 2
    before = F.when(tp0 + fp0 > 0, ratio(tp0, tp0 + fp0)).otherwise(1.0)
    pr = (ratio(tp, pos) - ratio(tp0, pos)) * (ratio(tp, tp + fp) + before) / 2
    return _cumulative(made).groupBy("model").agg(F.round(F.sum(roc), 6).alias("roc_auc"), F.round(F.sum(pr), 6).alias("pr_auc"))


def roc_auc(df: DataFrame) -> DataFrame:
    """Area under the ROC points by trapezoids from (0, 0)."""
    return areas(points(df)).select("model", "roc_auc")


def pr_auc(df: DataFrame) -> DataFrame:
    """Area under the precision-recall points by trapezoids from recall 0, precision 1."""
    return areas(points(df)).select("model", "pr_auc")


def log_loss(df: DataFrame, floor: float = 1e-7) -> DataFrame:
    """Mean negative log of the probability given to the truth, which counts as no less than ``floor``."""
    p = F.greatest(F.lit(floor), F.when(F.col("y") == 1, F.col("score")).otherwise(1 - F.col("score")))
    return df.filter("y is not null and score is not null").groupBy("model").agg(F.round(F.avg(-F.log(p)), 6).alias("log_loss"))


def comparison(df: DataFrame) -> DataFrame:
    """``model, metric, value``: five metrics of each model, long; the predictions are read once."""
    made = written(points(df), "points")
    one, none = F.col("yhat") == 1, F.col("yhat") == 0
    cells = made.filter("yhat is not null").groupBy("model").agg(
        F.sum(F.when(one, F.col("p")).otherwise(0)).alias("tp"), F.sum(F.when(one, F.col("n")).otherwise(0)).alias("fp"), F.sum(F.when(none, F.col("p")).otherwise(0)).alias("fn"), F.sum(F.when(none, F.col("n")).otherwise(0)).alias("tn")
    )
    wide = _ratios(cells).drop("accuracy").join(areas(made), "model")
    return wide.unpivot("model", ["precision", "recall", "f1", "roc_auc", "pr_auc"], "metric", "value")


def comparison_arrays(long: DataFrame) -> DataFrame:
    """``metric, models, values``: parallel arrays in the models' order, one row for each metric."""
    pairs = F.array_sort(F.collect_list(F.struct("model", "value")))
    return long.groupBy("metric").agg(pairs.alias("v")).select("metric", F.col("v.model").alias("models"), F.col("v.value").alias("values"))
