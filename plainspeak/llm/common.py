"""Helpers that the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored

#: A key is hot if it holds more than 1/HOT_KEYS of all rows: there are fewer than HOT_KEYS hot keys
#: whatever the data, which bounds what is broadcast.
HOT_KEYS = 2_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def whole_text(text: str | Column = "text") -> Column:
    """The text as a string, null as the empty string."""
    return F.coalesce((F.col(text) if isinstance(text, str) else text).cast("string"), F.lit(""))


def fresh(name: str, taken: list[str]) -> str:
    """``name`` with as many underscores in front as it takes to differ from the columns ``taken``."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name = f"_{name}"
    return name


def left_join_by_key(rows: DataFrame, keyed: DataFrame, key: str, weight: str) -> DataFrame:
    """``rows`` left-joined with ``keyed`` (one row a key; ``weight``: how many of ``rows`` it meets).

    Keys with more than 1/HOT_KEYS of the total weight are broadcast (fewer than HOT_KEYS rows), so a
    key with a third of all rows isn't sent to one task. The others meet in a shuffle join. Both
    frames should be stored ones: each is read twice. Every row of ``rows`` comes out once; ``weight``
    goes with the other columns of ``keyed``.
    """
    total = keyed.agg(F.sum(weight)).first()[0] or 0
    is_hot = F.col(weight) * HOT_KEYS > F.lit(int(total))
    hot = keyed.filter(is_hot)
    flag = fresh("hot", [*rows.columns, *keyed.columns])
    marked = rows.join(F.broadcast(hot.select(key, F.lit(True).alias(flag))), key, "left")
    cold_rows = marked.filter(F.col(flag).isNull()).drop(flag)
    hot_rows = rows.join(F.broadcast(hot), key)
    return cold_rows.join(keyed.filter(~is_hot), key, "left").unionByName(hot_rows)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Written once to the shared folder, as small as Spark can, and read again: lineage ends here."""
    return stored(df, name, compression="zstd")
