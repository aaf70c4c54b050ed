"""The dense classifier fitted in epochs, each kept in a folder, so that a fit goes on after a stop.

    <path>/epoch-000/model   the fitted pipeline
    <path>/epoch-000/loss    one row: epoch, loss, accuracy on the validation part; written last
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler, VectorSizeHint
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import folder_names, stored
from ..sources.artifacts import load_model, load_table, save_model, save_table
from .training import classifier, validate


@dataclass
class EpochFit:
    model: PipelineModel
    """The epoch with the smallest validation loss, the earliest on ties."""
    best: int
    history: DataFrame
    """epoch, loss, accuracy."""


def _folder(path: str, epoch: int) -> str:
    return f"{path.rstrip('/')}/epoch-{epoch:03d}"


def finished_epochs(spark: SparkSession, path: str) -> int:
    """Epochs in a row from the first one whose loss is written; what a stopped epoch left is not counted."""
    epoch = 0
    while "_SUCCESS" in folder_names(spark, f"{_folder(path, epoch)}/loss"):
        epoch += 1
    return epoch


def fit_epochs(
    train: DataFrame, dev: DataFrame, path: str, inputs: int, epochs: int = 6, steps: int = 10, label: str = "label_id"
) -> EpochFit:
    """Fit on ``pooled`` vectors of ``inputs`` numbers. An epoch is ``steps`` steps that start from the weights of the
    epoch before; its model and its loss on ``dev`` are written to ``path``. Epochs found there are not fitted
    again, so a second call goes on where the first one stopped, or adds epochs to a finished fit.

    ``path`` belongs to one training set and one setting of ``inputs`` and ``steps``. An empty ``dev``
    gives null losses: then the last epoch counts as the best.
    """
    if epochs < 1:
        raise ValueError("epochs: at least 1")
    spark = train.sparkSession
    done = finished_epochs(spark, path)
    if done < epochs:
        prepared = stored(train.select("pooled", label), "epoch-rows")
        learner = classifier("word_vectors", label, inputs).setMaxIter(steps)
        # The size is stated, so that an empty part can be scored as well.
        sized = VectorSizeHint(inputCol="pooled", size=inputs)
        assemble = VectorAssembler(inputCols=["pooled"], outputCol="features")
        if done:
            learner = learner.setInitialWeights(load_model(f"{_folder(path, done - 1)}/model").stages[-1].weights)
        for epoch in range(done, epochs):
            model = Pipeline(stages=[sized, assemble, learner]).fit(prepared)
            save_model(model, f"{_folder(path, epoch)}/model")
            loss = validate(model, dev, label).select(F.lit(epoch).alias("epoch"), "loss", "accuracy")
            save_table(loss.coalesce(1), f"{_folder(path, epoch)}/loss")
            learner = learner.setInitialWeights(model.stages[-1].weights)
    history = load_table(spark, f"{_folder(path, 0)}/loss")
    for epoch in range(1, max(done, epochs)):
        history = history.unionByName(load_table(spark, f"{_folder(path, epoch)}/loss"))
    # One row an epoch.
    known = [(r["loss"], r["epoch"]) for r in history.collect() if r["loss"] is not None and math.isfinite(r["loss"])]
    best = min(known)[1] if known else max(done, epochs) - 1
    return EpochFit(load_model(f"{_folder(path, best)}/model"), best, history)
