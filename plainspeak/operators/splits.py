"""Statistics of labelled corpora and their splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels


def label_counts_by_split(tagged: DataFrame) -> DataFrame:
    """label_id as a name, set, counter summed. Only the label is renamed, not the counts."""
    return (
        tagged.groupBy("label_id", "set")
        .agg(F.sum("counter").alias("counter"))
        .select(labels.label_capitals("label_id").alias("label_id"), "set", "counter")
    )


def label_counts_after_resplit(tagged: DataFrame, merge: dict[str, str] | None = None) -> DataFrame:
    """Splits renamed (by default Dev into Train), then counted."""
    merge = {"Dev": "Train"} if merge is None else merge
    return label_counts_by_split(
        tagged.withColumn("set", labels.replace_values("set", merge))
    )


def rows_by_split(tagged: DataFrame) -> DataFrame:
    return tagged.groupBy("set").agg(F.count("*").alias("n"))
