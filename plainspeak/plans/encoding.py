"""Number sequences for models that read them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed_values import SEQUENCE_LENGTH
from ..operators.vocabulary import encode
from ..session import stored


def with_row_ids(rows: DataFrame, name: str = "row_id") -> DataFrame:
    """Rows with a unique number. They are written once, so every later reading of them,
    also after the loss of an executor, sees the same numbers."""
    return stored(rows.withColumn(name, F.monotonically_increasing_id()), "rows")


def encode_comments(
    cleaned: DataFrame,
    vocabulary: DataFrame,
    key: str | None = None,
    text: str = "comment_clean",
    name: str = "comment_encoded",
    length: int = SEQUENCE_LENGTH,
) -> DataFrame:
    """Add the number sequence of each comment. ``key`` is a unique column; comments as
    they are captured have none and are numbered first. On a stream this belongs inside
    the delivery of a micro-batch (``streaming.sinks.each_batch``)."""
    if key is None:
        with_ids = encode_comments(with_row_ids(cleaned), vocabulary, "row_id", text, name, length)
        return with_ids.drop("row_id")
    encoded = encode(cleaned, vocabulary, key, text, length).withColumnRenamed("encoded", name)
    return cleaned.join(encoded, key)
