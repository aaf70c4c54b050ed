"""Applying a model to cleaned comments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import SparkFiles
from pyspark.ml import PipelineModel
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import labels


def score_comments(model: PipelineModel, cleaned: DataFrame, text: str = "comment_clean") -> DataFrame:
    """timestamp, user, comment, prediction. Only the new rows are scored, row by row, so
    the same function serves batch and stream. ``model`` reads ``text_clean``."""
    scored = model.transform(cleaned.withColumn("text_clean", F.col(text)))
    shown = "comment_norm" if "comment_norm" in cleaned.columns else "comment"
    return from_scores(scored.withColumn("scores", vector_to_array("probability", "float32")), shown)


def from_scores(scored: DataFrame, comment: str = "comment") -> DataFrame:
    """Class scores (array) to the scored-comment table."""
    return scored.select(
        "timestamp", "user", F.col(comment).alias("comment"), labels.argmax("scores").alias("prediction")
    )


def array_model(
    make_predict: Callable, encoded: str = "comment_encoded", length: int = 100, batch_size: int = 256
) -> Callable[[DataFrame], DataFrame]:
    """Any model on number arrays, as Arrow batches in Python workers.

    ``make_predict`` runs once per worker and returns a function from a 2-d array
    (rows, length) to a 2-d array of class scores (rows, 3).
    """
    predict = predict_batch_udf(
        make_predict,
        return_type=T.ArrayType(T.FloatType()),
        batch_size=batch_size,
        input_tensor_shapes=[[length]],
    )
    return lambda frame: frame.withColumn("scores", predict(F.col(encoded)))


def shipped_model(
    spark: SparkSession, path: str, load: Callable[[str], Callable], encoded: str = "comment_encoded",
    length: int = 100, batch_size: int = 256,
) -> Callable[[DataFrame], DataFrame]:
    """``array_model`` of a model file. Spark copies the file to each executor once; ``load(local path)`` runs
    once a worker and returns what ``make_predict`` would. A session knows files by name, so each
    version of a model needs a name of its own. ``path``: a file of the driver, or in any store Spark reads."""
    spark.sparkContext.addFile(path)
    name = path.rstrip("/").rsplit("/", 1)[-1]

    def make_predict():
        return load(SparkFiles.get(name))

    return array_model(make_predict, encoded, length, batch_size)
