"""Summaries of an unbounded stream, for any range of time: sketches a minute (users) and an hour (words).

A micro-batch writes the sketches of its own rows, keeps no state and reads nothing of what came before.
It counts from its entry in the log on. Every so many batches the sketches so far are merged by bucket into a
base, so a reader opens the base and the batches since, and their size follows the time covered, not the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import sketches
from ..session import folder_names, make_folder, remove
from . import sinks

_STATE = "struct<sketch: binary, maxItemsTracked: int, itemDataType: string, itemDataTypeDDL: string>"
_SCHEMA = {
    "users": "minute timestamp, users binary, unnamed boolean",
    "words": f"hour timestamp, words {_STATE}, seen bigint",
}


class Summaries:
    """Rows need ``event_time``, ``user`` and ``comment``; rows without a time are in the bucket NULL, which
    only a range open at both ends takes in."""

    def __init__(
        self, spark: SparkSession, folder: str, merge_every: int = 100, tracked: int = sketches.WORDS_TRACKED
    ) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.merge_every = merge_every
        self.tracked = tracked

    def start(self, stream: DataFrame, every: str | None = "20 seconds") -> StreamingQuery:
        return sinks.each_batch(stream, self.deliver, self.folder, every)

    def deliver(self, batch: DataFrame, batch_id: int) -> None:
        """The same batch again changes nothing once it is in the log, and replaces its tables before."""
        done, base = self._numbers("log"), self._base()
        if batch_id in done or (base is not None and batch_id <= base):
            return
        minute, hour = sketches.bucket(), sketches.bucket(unit="hour")
        parts = {
            "users": sketches.user_sketches(batch, minute),
            "words": sketches.word_sketches(batch, hour, tracked=self.tracked),
        }
        for name, part in parts.items():
            part.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch-{batch_id}")
        make_folder(self.spark, f"{self.folder}/log/{batch_id}")
        if (batch_id + 1) % self.merge_every == 0:
            self._merge(batch_id)

    def users(self, first=None, last=None) -> DataFrame:
        """count_user of minutes from ``first`` on and before ``last``."""
        return sketches.count_users(self._range("users", "minute", first, last))

    def user_buckets(self) -> DataFrame:
        """minute, users, unnamed: several rows a minute may have to be merged."""
        return self._range("users", "minute", None, None)

    def top_words(self, number: int, first=None, last=None) -> DataFrame:
        """text, size, bound over hours from ``first`` on and before ``last``."""
        return sketches.frequent_words(self._range("words", "hour", first, last), number, self.tracked)

    def _range(self, name: str, column: str, first, last) -> DataFrame:
        rows = self._parts(name)
        if first is not None:
            rows = rows.filter(F.col(column) >= F.lit(first))
        return rows if last is None else rows.filter(F.col(column) < F.lit(last))

    def _parts(self, name: str) -> DataFrame:
        base = self._base()
        paths = [f"{self.folder}/{name}/batch-{n}" for n in self._numbers("log") if base is None or n > base]
        if base is not None:
            paths.append(f"{self.folder}/{name}/base-{base}")
        if not paths:
            return self.spark.createDataFrame([], _SCHEMA[name])
        return self.spark.read.schema(_SCHEMA[name]).parquet(*paths)

    def _merge(self, upto: int) -> None:
        """One base of all sketches so far. What the base before had replaced goes; what this one replaces
        stays until the next, as readers may be at it."""
        before = self._base()
        users = sketches.merge_users(self._parts("users"), F.col("minute"))
        words = sketches.merge_words(self._parts("words"), F.col("hour"), tracked=self.tracked)
        for name, merged in (("users", users), ("words", words)):
            merged.write.mode("overwrite").parquet(f"{self.folder}/{name}/base-{upto}")
        make_folder(self.spark, f"{self.folder}/bases/{upto}")
        if before is None:
            return
        for n in self._numbers("log"):
            if n <= before:
                for name in _SCHEMA:
                    remove(self.spark, f"{self.folder}/{name}/batch-{n}")
                remove(self.spark, f"{self.folder}/log/{n}")
        for n in self._numbers("bases"):
            if n < before:
                for name in _SCHEMA:
                    remove(self.spark, f"{self.folder}/{name}/base-{n}")
                remove(self.spark, f"{self.folder}/bases/{n}")

    def _numbers(self, name: str) -> list[int]:
        return sorted(int(n) for n in folder_names(self.spark, f"{self.folder}/{name}"))

    def _base(self) -> int | None:
        return max(self._numbers("bases"), default=None)
