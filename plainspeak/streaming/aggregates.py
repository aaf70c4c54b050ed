"""Running aggregates on a stream of scored comments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.fixed_values import LABEL_NAMES


def running_label_counts(scored: DataFrame) -> DataFrame:
    """label, n over everything seen. State: one row a label."""
    return (
        scored.filter(F.col("prediction").isNotNull())
        .groupBy("prediction")
        .agg(F.count("*").alias("n"))
        .select(labels.label_name("prediction").alias("label"), "n")
    )


def running_users(scored: DataFrame) -> DataFrame:
    """Approximate number of users seen. State: one sketch of fixed size, where exact
    counting would keep every user."""
    return scored.agg(
        (
            F.approx_count_distinct("user")
            + F.coalesce(F.max(F.col("user").isNull().cast("int")), F.lit(0))
        ).alias("count_user")
    )


def minute_counts(scored: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """minute, clean, offensive, hate per event-time minute. In append mode a minute comes
    out once, when the watermark has passed it, and its state is dropped."""
    counts = [
        F.count_if(F.col("prediction") == code).alias(name.lower())
        for code, name in LABEL_NAMES.items()
    ]
    return (
        scored.filter(F.col("prediction").isNotNull())
        .withWatermark("event_time", delay)
        .groupBy(F.window("event_time", "1 minute").alias("w"))
        .agg(*counts)
        .select(F.col("w.start").alias("minute"), *[n.lower() for n in LABEL_NAMES.values()])
    )


def drop_repeats(comments: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """The same comment of the same user passes once within the delay.

    State: the time at which each pair of the delay passed. Rows of one pair are judged by one task;
    a step before it that dropped some of them would renew its own times from rows that never passed.
    """
    marked = comments.withWatermark("event_time", delay)
    return marked.dropDuplicatesWithinWatermark(["user", "comment"])


def new_users(scored: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """minute, user: each user once a minute, at the first row that names it there. Exact counts of any range
    are distinct users over its minutes. State: the pairs of minutes the watermark has not passed; rows
    behind it are dropped, as are rows without a time."""
    return (
        scored.withWatermark("event_time", delay)
        .select(F.window("event_time", "1 minute").alias("w"), "user")
        .dropDuplicates(["w", "user"])
        .select(F.col("w.start").alias("minute"), "user")
    )
