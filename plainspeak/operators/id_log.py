"""A log of ids that keeps growing, dealt into buckets by id, and the look-up of new ids in it.

New ids are few beside the log. The log is never shuffled: its files lie in buckets by id, so only the new ids
move, to the buckets' places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed when a log is made. A bucket is one task's share of a look-up.
BUCKETS = 64


class IdLog:
    """A bucketed table ``id`` in the session's warehouse. An id may have been added more than once."""

    def __init__(self, spark: SparkSession, name: str, buckets: int = BUCKETS) -> None:
        self.spark = spark
        self.name = name
        self.buckets = buckets

    def add(self, ids: DataFrame) -> None:
        """Append the ids; NULL and empty ones are left out, copies within the call are one. Each bucket gets one file
        a call, as rows are dealt to tasks the way the buckets are."""
        rows = ids.select(F.col("id").cast("string").alias("id")).filter("id <> ''").distinct()
        (
            rows.repartition(self.buckets, "id")
            .write.mode("append")
            .format("parquet")
            .bucketBy(self.buckets, "id")
            .sortBy("id")
            .saveAsTable(self.name)
        )

    def table(self) -> DataFrame:
        if not self.spark.catalog.tableExists(self.name):
            return self.spark.createDataFrame([], "id string")
        return self.spark.table(self.name)

    def unseen(self, new: DataFrame) -> DataFrame:
        """Ids of ``new`` that the log lacks, each once; NULL and empty ones are left out.

        First the ids that are in the log, by a semi-join from the log's side: there are no more of them than
        new ids, however often the log holds each. Then what is left of the new ones.
        """
        wanted = new.select(F.col("id").cast("string").alias("id")).filter("id <> ''").distinct()
        # Dealt as the buckets are: one exchange for both joins, and none for the log.
        dealt = wanted.repartition(self.buckets, "id")
        known = self.table().join(dealt.hint("merge"), "id", "left_semi").distinct()
        return dealt.join(known.hint("merge"), "id", "left_anti")

    def add_unseen(self, new: DataFrame, keep) -> DataFrame:
        """The unseen ids, after they have been added. ``keep`` stores them first (``session.stored``), so that what
        is added and what is returned are the same rows, also after a lost executor."""
        fresh = keep(self.unseen(new))
        self.add(fresh)
        return fresh
