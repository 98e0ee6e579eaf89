"""A text classifier over hashed words, in place of a fine-tuned language model: same interface, scores of class 1.

Life cycle: ``train`` fits at once; ``train_epochs`` goes epoch by epoch, logs the losses, saves a checkpoint after each, and
resumes from the last one; ``load`` and ``predict`` score a saved model by name; ``evaluate_all`` scores every saved model.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptloom.operators import descent, metrics
from promptloom.operators.metrics import threshold
from promptloom.storage import written

_SCORES = "model string, y int, score double, yhat int"


def _features(features: int) -> list:
    words = RegexTokenizer(inputCol="text", outputCol="_words", pattern=r"[\s\p{P}]+")
    return [words, HashingTF(inputCol="_words", outputCol="_features", numFeatures=features)]


def train(df: DataFrame, features: int = 4096, epochs: int = 10, regularisation: float = 0.01) -> PipelineModel:
    """Fit on ``text, label`` (0/1)."""
    return Pipeline(stages=[*_features(features), LogisticRegression(featuresCol="_features", labelCol="label", maxIter=epochs, regParam=regularisation)]).fit(df)


def predict(model: PipelineModel, df: DataFrame, name: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """``model, carried columns, y, score, yhat``."""
    score = vector_to_array("probability")[1]
    return model.transform(df).select(F.lit(name).alias("model"), *carry, F.col("label").cast("int").alias("y"), score.alias("score"), threshold(score).alias("yhat"))


def _done(spark: SparkSession, path: str) -> int:
    """The last epoch with a whole checkpoint."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/checkpoint-epoch-*/metadata/_SUCCESS")
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop)
    return max((int(re.search(r"checkpoint-epoch-(\d+)/", s.getPath().toString()).group(1)) for s in found or []), default=0)


def _network(spark: SparkSession, features: int, seed: int, weights: np.ndarray | None = None) -> MultilayerPerceptronClassificationModel:
    """A network without hidden layers with these weights, or with random ones: no step is made, the two rows only name the labels."""
    step = MultilayerPerceptronClassifier(featuresCol="_features", labelCol="label", layers=[features, 2], maxIter=0, seed=seed)
    if weights is not None:
        step = step.setInitialWeights(Vectors.dense(weights))
    return step.fit(spark.createDataFrame([(Vectors.sparse(features, {}), float(y)) for y in (0, 1)], ["_features", "label"]))


def _sparse(base: PipelineModel, rows: DataFrame) -> DataFrame:
    """``label, indices, values``: only the features that a row has. A label that is not 0 or 1 is an error."""
    label = F.when(F.col("label").isin(0, 1), F.col("label").cast("double")).otherwise(F.raise_error(F.lit("labels must be 0 or 1")))
    made = base.transform(rows.select("text", label.alias("label"))).select("label", F.unwrap_udt("_features").alias("f"))
    return made.select("label", "f.indices", "f.values")


def train_epochs(
    train_rows: DataFrame, eval_rows: DataFrame, folder: str, name: str, epochs: int = 3, iterations: int = 5, features: int = 4096,
    log: Callable[[int, float | None, float | None, dict], None] | None = None,
) -> PipelineModel:
    """A network without hidden layers, trained for ``epochs`` times ``iterations`` steps, each epoch from the weights of the one before.

    After each epoch ``{folder}/{name}/checkpoint-epoch-{e}`` is saved and ``log(e, training loss, evaluation loss, metrics)`` called; a
    later call with the same folder goes on after the last whole checkpoint. The end is saved as ``{folder}/{name}/final_model``. A loss
    that is undefined (no rows) is ``None``. Training rows must hold both labels.

    Spark's own training keeps a dense copy of the rows, every feature of each; here rows stay sparse, written once, and only the weights are dense.
    """
    spark = train_rows.sparkSession
    path, base = f"{folder}/{name}", Pipeline(stages=_features(features)).fit(train_rows)
    done = _done(spark, path)
    model = PipelineModel.load(f"{path}/checkpoint-epoch-{done}") if done else None
    if done < epochs:
        objective = descent.softmax_loss(written(_sparse(base, train_rows), "features"))
    for epoch in range(done + 1, epochs + 1):
        start = (_network(spark, features, epoch) if model is None else model.stages[-1]).weights
        weights, history = descent.minimise(objective, start.toArray(), iterations)
        fitted = _network(spark, features, epoch, weights)
        model = PipelineModel([*base.stages, fitted])
        model.write().overwrite().save(f"{path}/checkpoint-epoch-{epoch}")
        if log is not None:
            scored = predict(model, eval_rows, name)
            loss, found = metrics.log_loss(scored).first(), metrics.precision_recall_f1(scored).first()
            log(epoch, None if math.isnan(history[-1]) else history[-1], loss.log_loss if loss else None, {k: v for k, v in found.asDict().items() if k != "model"} if found else {})
    if model is not None:
        model.write().overwrite().save(f"{path}/final_model")
    return model


def load(folder: str, name: str) -> PipelineModel:
    """A finished model by its name."""
    return PipelineModel.load(f"{folder}/{name}/final_model")


def for_each(names: list[str], work: Callable[[str], object]) -> tuple[dict[str, object], dict[str, str]]:
    """What the work gives for each name, and the first line of the error of each name for which it fails: one broken model costs none of the others."""
    done, failed = {}, {}
    for name in names:
        try:
            done[name] = work(name)
        except Exception as e:  # noqa: BLE001
            failed[name] = str(e).strip().split("\n")[0]
    return done, failed


def evaluate_all(names: list[str], folder: str, df: DataFrame, carry: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, str]]:
    """The predictions of all saved models on ``df`` and the errors of those that can't be loaded. Without any model there are no rows."""
    done, failed = for_each(names, lambda name: predict(load(folder, name), df, name, carry))
    out = None
    for part in done.values():
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = df.sparkSession.createDataFrame([], _SCORES)
    return out, failed
