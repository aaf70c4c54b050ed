"""Moderation panels over scored comments.

Input columns: timestamp (epoch seconds), user, comment, prediction (0, 1, 2). Each
panel is one DataFrame; all of them aggregate in the map tasks first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels, times
from ..functions import text as X
from ..functions.fixed_values import LABEL_NAMES, MINUTE_FORMAT, RECENT_ROWS, TOP_WORDS


def label_counts(scored: DataFrame) -> DataFrame:
    """label, n: most frequent first; rows without a prediction are not counted."""
    return (
        scored.filter(F.col("prediction").isNotNull())
        .groupBy("prediction")
        .agg(F.count("*").alias("n"))
        .select(labels.label_name("prediction").alias("label"), "n")
        .orderBy(F.desc("n"), "label")
    )


def label_counters(scored: DataFrame) -> DataFrame:
    """One row: count_clean, count_offensive, count_hate. Users: ``distinct_users``."""
    return scored.agg(
        *[
            F.count_if(F.col("prediction") == code).alias(f"count_{name.lower()}")
            for code, name in LABEL_NAMES.items()
        ]
    )


def distinct_users(scored: DataFrame) -> DataFrame:
    """One row: count_user. A missing user counts as one user."""
    return (
        scored.select("user")
        .distinct()
        .agg(F.count("*").alias("count_user"))
    )


def approximate_users(scored: DataFrame) -> DataFrame:
    return scored.agg(
        (
            F.approx_count_distinct("user")
            + F.coalesce(F.max(F.col("user").isNull().cast("int")), F.lit(0))
        ).alias("count_user")
    )


def label_by_minute(scored: DataFrame) -> DataFrame:
    """minute, date_time, clean, offensive, hate: in time order, zero where a class is absent."""
    minute = F.date_trunc("minute", times.event_time("timestamp"))
    counts = [
        F.count_if(F.col("prediction") == code).alias(name.lower())
        for code, name in LABEL_NAMES.items()
    ]
    return (
        scored.filter(F.col("prediction").isNotNull() & F.col("timestamp").isNotNull())
        .groupBy(minute.alias("minute"))
        .agg(*counts)
        .withColumn("date_time", F.date_format("minute", MINUTE_FORMAT))
        .orderBy("minute")
    )


def recent_comments(scored: DataFrame, rows: int = RECENT_ROWS) -> DataFrame:
    """The last rows by time and user, oldest first, with display names."""
    display = {
        "date": "Date", "time": "Time", "user": "User", "comment": "Comment", "label": "Prediction",
    }
    last = (
        scored.filter(F.col("timestamp").isNotNull())
        .select("timestamp", "user", "comment", "prediction")
        .orderBy(F.desc("timestamp"), F.desc("user"), F.desc("comment"))
        .limit(rows)
    )
    return (
        last.orderBy("timestamp", "user", "comment")
        .select(
            times.date_text("timestamp").alias("date"),
            times.clock_text("timestamp").alias("time"),
            "user",
            "comment",
            labels.label_name("prediction").alias("label"),
        )
        .withColumnsRenamed(display)
    )


def time_labels(scored: DataFrame) -> DataFrame:
    """Display columns next to the scored ones: label, date_time, date, time."""
    return scored.withColumns(
        {
            "label": labels.label_name("prediction"),
            "date_time": times.minute_text("timestamp"),
            "date": times.date_text("timestamp"),
            "time": times.clock_text("timestamp"),
        }
    )


def word_counts(scored: DataFrame, comment: str = "comment") -> DataFrame:
    return (
        scored.select(F.explode(X.display_words(comment)).alias("text"))
        .groupBy("text")
        .agg(F.count("*").alias("size"))
    )


def top_words(scored: DataFrame, number: int = TOP_WORDS, comment: str = "comment") -> DataFrame:
    """text, size: the most frequent words, ties in word order."""
    return word_counts(scored, comment).orderBy(F.desc("size"), "text").limit(number)


def records(panel: DataFrame, columns: list[str], order: list) -> DataFrame:
    """A small panel (a top-k, or one row a label) as one JSON array, rows in order."""
    pairs = F.array_sort(F.collect_list(F.struct(*order, F.struct(*columns).alias("record"))))
    return panel.agg(
        F.to_json(F.transform(pairs, lambda p: p["record"])).alias("records")
    )
