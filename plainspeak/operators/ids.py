"""Id logs: which ids are new."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unseen_ids(new: DataFrame, seen: DataFrame) -> DataFrame:
    """Ids of ``new`` not in ``seen``, each once. Copies are removed before the anti-join,
    so an id that makes up much of the input is one row when it is joined."""
    return (
        new.select("id")
        .filter(F.col("id").isNotNull())
        .distinct()
        .join(seen.select("id").distinct(), "id", "left_anti")
    )


def first_ids(ids: DataFrame, number: int) -> DataFrame:
    """The first ``number`` distinct ids."""
    return ids.select("id").distinct().orderBy("id").limit(number)
