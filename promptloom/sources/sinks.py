"""DataFrames to files. Tables go out as Spark writes them; single files are for small results."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptloom.operators import metrics

#: Rows that a single-file sink takes; a larger result belongs into a table.
MOST_ROWS = 100_000


def json_lines(df: DataFrame, path: str) -> None:
    """A folder of JSON lines, nulls written, written by all executors."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def _small(df: DataFrame, order: list[str], most: int) -> list:
    rows = (df.orderBy(*order) if order else df).select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("j")).take(most + 1)
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: write them with json_lines")
    return [json.loads(r.j) for r in rows]


def _write(path: str, content: object) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(content, f, ensure_ascii=False, indent=2)


def json_array(df: DataFrame, path: str, order: list[str], wrap: str | None = None, most: int = MOST_ROWS) -> float:
    """One indented JSON list in the given order, or an object with the list under ``wrap``; folders are made. Gives the size in MB."""
    rows = _small(df, order, most)
    _write(path, {wrap: rows} if wrap else rows)
    return os.path.getsize(path) / 2**20


def statistics_json(stats: DataFrame, output: str, metadata: dict, path: str | None = None) -> str:
    """A one-row statistics frame and metadata, by default beside ``output`` under ``_statistics``. Gives the path."""
    stem, suffix = os.path.splitext(output)
    path = path or (stem if suffix == ".json" else output) + "_statistics.json"
    rows = _small(stats, [], 1)
    _write(path, {**(rows[0] if rows else {}), "metadata": metadata})
    return path


def metrics_report(predictions: DataFrame, folder: str) -> list[str]:
    """For each model ``metrics_report.json`` (metrics, class report, confusion matrix as rows of truth) and ``metrics_report.txt`` in its own
    folder under ``folder``. Gives the models, sorted."""
    named: dict[str, dict] = {}
    for r in metrics.comparison(predictions).collect():
        named.setdefault(r.model, {"metrics": {}, "classification_report": {}, "confusion_matrix": [[0, 0], [0, 0]]})["metrics"][r.metric] = r.value
    for r in metrics.class_report(predictions).collect():
        named[r.model]["classification_report"][r.row] = {"precision": r.precision, "recall": r.recall, "f1": r.f1, "support": r.support}
    for r in metrics.confusion(predictions).collect():
        named[r.model]["confusion_matrix"][r.y][r.yhat] = r.n
    for model, found in named.items():
        _write(os.path.join(folder, model, "metrics_report.json"), {"model_name": model, **found})
        lines = [f"Model: {model}", "=" * 50, "", *(f"{name.upper().replace('_', ' ')}: {value:.4f}" for name, value in sorted(found["metrics"].items())), "", "Classification Report:"]
        lines += [f"{row:<12}  {x['precision']:.4f}  {x['recall']:.4f}  {x['f1']:.4f}  {x['support']}" for row, x in found["classification_report"].items()]
        lines += ["", "Confusion Matrix (rows: truth):", *("  ".join(map(str, row)) for row in found["confusion_matrix"])]
        with open(os.path.join(folder, model, "metrics_report.txt"), "w", encoding="utf-8") as f:
            f.write("\n".join(lines) + "\n")
    return sorted(named)


def append_log(path: str, epoch: int, train_loss: float | None, eval_loss: float | None, eval_metrics: dict | None = None) -> None:
    """One epoch's block to a training log, which is begun if there is none; ``readers.training_log`` reads it. A missing loss is ``N/A``."""
    shown = ["N/A" if x is None else f"{x:.6f}" for x in (train_loss, eval_loss)]
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "a", encoding="utf-8") as f:
        f.write(f"Epoch {epoch}:\n  Training Loss: {shown[0]}\n  Eval Loss: {shown[1]}\n  Eval Metrics: {json.dumps(eval_metrics or {})}\n{'-' * 30}\n")


def corpus_files(corpus: DataFrame | None, output: str, stats: DataFrame | None = None, metadata: dict | None = None) -> dict:
    """The corpus as one JSON list in source, file and list order, and its statistics beside it; gives the statistics. Without batch
    files (``None``) nothing is written, and the statistics are empty."""
    if corpus is None:
        return {}
    json_array(corpus.select("src_ord", "file_ord", "pos", "prompt", "label", "source"), output, ["src_ord", "file_ord", "pos"])
    found = _small(stats, [], 1)[0] if stats is not None else {}
    if stats is not None:
        statistics_json(stats, output, metadata or {})
    return found
