"""Numbering rows in a global order without putting them all in one task."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

_PARTITION_SHIFT = 33  # monotonically_increasing_id: partition number above bit 33


def number_rows(df: DataFrame, order: list[Column], name: str, start: int = 1) -> DataFrame:
    """Rows numbered from ``start`` in the given (total) order.

    A range-partitioned sort puts row ranges into tasks; each row takes its place within
    its task; the places are shifted by the sizes of the tasks before. The sorted rows are
    written once, so both passes see the same task boundaries even if executors are lost
    in between. The driver gets one number a sort task, which does not grow with the rows.
    """
    place = "__place"
    placed = stored(
        df.orderBy(*order).withColumn(place, F.monotonically_increasing_id()), "numbered"
    )
    task = F.shiftright(F.col(place), _PARTITION_SHIFT)
    sizes = {r[0]: r[1] for r in placed.groupBy(task).count().collect()}
    counts = [sizes.get(i, 0) for i in range(max(sizes, default=0) + 1)]
    starts = list(accumulate([start, *counts[:-1]]))
    first = F.element_at(F.array(*[F.lit(s).cast("bigint") for s in starts]), (task + 1).cast("int"))
    within = F.col(place) - F.shiftleft(task, _PARTITION_SHIFT)
    return placed.withColumn(name, first + within).drop(place)
