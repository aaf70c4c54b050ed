"""Removing stop words when the list may be of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .lookup import look_up

LIST_LIMIT = 20_000


def bounded_list(stop_words: DataFrame, limit: int = LIST_LIMIT) -> list[str] | None:
    """The words, if there are no more than ``limit``; None otherwise. Reads at most one
    row more than the limit."""
    rows = stop_words.select("word").limit(limit + 1).collect()
    return None if len(rows) > limit else [r["word"] for r in rows if r["word"] is not None]


def remove_stop_words(
    docs: DataFrame, stop_words: DataFrame, key: str, text: str, limit: int = LIST_LIMIT
) -> DataFrame:
    """Columns: key, text, with listed words removed and the rest joined by one space, one row for each
    row of ``docs`` (``key`` needn't be unique). A short list goes into the row expression; a long one
    is joined; the result is the same. NULL words of the list match nothing."""
    listed = bounded_list(stop_words, limit)
    if listed is not None:
        return docs.select(key, X.drop_stop_words(text, listed).alias(text))
    return remove_stop_words_by_join(docs, stop_words, key, text)


def remove_stop_words_by_join(
    docs: DataFrame, stop_words: DataFrame, key: str, text: str
) -> DataFrame:
    # The row's number tells rows of one key apart; all words of a row come from one task.
    numbered = docs.select(key, text, F.monotonically_increasing_id().alias("__row"))
    words = numbered.select(
        key, "__row", F.col(text).isNull().alias("none"), F.posexplode_outer(X.words(text)).alias("pos", "word")
    )
    listed = stop_words.select("word").distinct().withColumns({"n": F.lit(1), "stop": F.lit(True)})
    kept = look_up(words, listed, ["stop"], salt_from=["__row", "pos"]).select(
        key,
        "__row",
        "none",
        F.when(F.col("stop").isNull() & F.col("word").isNotNull(), F.struct("pos", "word")).alias("kept"),
    )
    lists = kept.groupBy(key, "__row", "none").agg(F.collect_list("kept").alias("kept"))
    ordered = F.transform(F.array_sort("kept"), lambda p: p["word"])
    joined = F.when(~F.col("none"), F.array_join(ordered, " "))
    return lists.select(key, joined.alias(text))
