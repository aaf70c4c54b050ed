"""The timeline of a stream, with a stated policy for late rows.

Every micro-batch adds the counts of its own rows to the minutes that are still open, and writes only
those. A minute closes once its end is ``delay`` or more before the newest time that the batches so far
held; it is then written a last time and never read again by a delivery. Rows whose minute was closed before
their batch, and rows without a time, go to a side table whole, under the reason, and are not counted.

A batch counts from its entry in the log on, which comes last and names the newest time so far. A delivery
repeated before that replaces its tables; one repeated after it (the same rows, as the id is) changes nothing.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.fixed_values import LABEL_NAMES
from ..session import folder_names, make_folder, remove
from . import sinks

_CLASSES = [name.lower() for name in LABEL_NAMES.values()]
_MINUTES = "minute timestamp, " + ", ".join(f"{name} bigint" for name in _CLASSES)
_START = datetime(1970, 1, 1)


class Timeline:
    """Folders: ``open`` (minutes that may still change, as of a batch), ``closed`` (minutes that a batch
    closed), ``base`` (closed minutes merged), ``late`` (rows not counted), ``log`` (an entry a batch).

    Rows need ``event_time`` and ``prediction``; other columns travel to the side table. A NULL prediction
    is a minute's row of no class: it moves the time on, opens its minute and counts nowhere. A batch
    without rows changes nothing but its entry.
    """

    def __init__(
        self, spark: SparkSession, folder: str, delay: timedelta = timedelta(minutes=10), merge_every: int = 100
    ) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.delay = delay
        self.merge_every = merge_every

    def start(self, stream: DataFrame, every: str | None = "20 seconds") -> StreamingQuery:
        return sinks.each_batch(stream, self.deliver, self.folder, every)

    def deliver(self, batch: DataFrame, batch_id: int) -> None:
        entries = self._entries()
        if entries and batch_id <= max(entries):
            return
        before = max(entries, default=None)
        newest = entries.get(before)
        shut = self._closed_below(newest)

        # One pass for the counts: whether a row is late depends on its minute alone.
        minute = F.date_trunc("minute", "event_time")
        counts = self._stored(
            batch.groupBy(minute.alias("minute")).agg(
                *[F.count_if(F.col("prediction") == code).alias(name.lower()) for code, name in LABEL_NAMES.items()],
                F.max(F.unix_micros("event_time")).alias("last"),
            ),
            f"counts/batch={batch_id}",
        )
        late = F.col("minute").isNull() if shut is None else F.col("minute").isNull() | (F.col("minute") < shut)
        seen, left_out = counts.agg(F.max("last"), F.count_if(late)).first()
        if left_out:  # a second pass, for what it leaves out only
            reason = F.when(F.col("event_time").isNull(), "no time").otherwise("late")
            rows = batch.withColumn("minute", minute).filter(late).drop("minute")
            rows.withColumn("reason", reason).write.mode("overwrite").parquet(f"{self.folder}/late/batch={batch_id}")

        fresh = counts.filter(~late).select("minute", *_CLASSES)
        if before is not None:
            fresh = fresh.unionByName(self._read(f"open/batch={before}"))
        merged = fresh.groupBy("minute").agg(*[F.sum(c).alias(c) for c in _CLASSES])
        newest = max((x for x in (newest, seen) if x is not None), default=None)
        closes = self._closed_below(newest)
        shut_now = F.lit(False) if closes is None else F.col("minute") < closes
        merged.filter(shut_now).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/closed/batch={batch_id}")
        merged.filter(~shut_now).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/open/batch={batch_id}")
        make_folder(self.spark, f"{self.folder}/log/{batch_id:012d}_{'none' if newest is None else newest}")
        self._tidy(batch_id, before)

    def minutes(self, with_late: bool = False) -> DataFrame:
        """minute and a count a class: of rows in time, or of all rows that have a time."""
        entries = self._entries()
        if not entries:
            return self.spark.createDataFrame([], _MINUTES)
        last, base = max(entries), self._base()
        parts = self._read(f"open/batch={last}")
        for n in entries:
            if base is None or n > base:
                parts = parts.unionByName(self._read(f"closed/batch={n}"))
        if base is not None:
            parts = parts.unionByName(self._read(f"base/batch={base}"))
        late = self.late_rows() if with_late else None
        if late is None:
            return parts  # a minute is in one place only
        counted = late.filter(F.col("event_time").isNotNull()).groupBy(
            F.date_trunc("minute", "event_time").alias("minute")
        ).agg(*[F.count_if(F.col("prediction") == code).alias(name.lower()) for code, name in LABEL_NAMES.items()])
        return parts.unionByName(counted).groupBy("minute").agg(*[F.sum(c).alias(c) for c in _CLASSES])

    def late_rows(self) -> DataFrame | None:
        """Rows left out, with batch and reason; None where there are none so far."""
        logged = set(self._entries()) | ({*range(self._base() + 1)} if self._base() is not None else set())
        names = [n for n in folder_names(self.spark, f"{self.folder}/late") if int(n.split("=")[1]) in logged]
        if not names:
            return None
        reader = self.spark.read.option("basePath", f"{self.folder}/late")
        return reader.parquet(*[f"{self.folder}/late/{n}" for n in names])

    def _closed_below(self, newest: int | None):
        """Minutes that start before it are closed."""
        if newest is None:
            return None
        end = _START + timedelta(microseconds=newest) - self.delay - timedelta(minutes=1)
        micros = (end - _START) // timedelta(microseconds=1)
        return F.timestamp_micros(F.lit(micros + 1))

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(_MINUTES).parquet(f"{self.folder}/{name}")

    def _stored(self, frame: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        frame.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def _entries(self) -> dict[int, int | None]:
        """Newest time in microseconds, a batch: of those since the base, and the base's own."""
        found = {}
        for name in folder_names(self.spark, f"{self.folder}/log"):
            number, newest = name.split("_")
            found[int(number)] = None if newest == "none" else int(newest)
        return found

    def _base(self) -> int | None:
        names = folder_names(self.spark, f"{self.folder}/bases")
        return max((int(n) for n in names), default=None)

    def _tidy(self, batch_id: int, before: int | None) -> None:
        """The working table of this batch goes, and open minutes that no delivery or reader needs; every so many
        batches the closed minutes so far become a base, and folders that the base before replaced go."""
        remove(self.spark, f"{self.folder}/counts/batch={batch_id}")
        entries, base = self._entries(), self._base()
        for name in folder_names(self.spark, f"{self.folder}/open"):
            number = int(name.split("=")[1])
            if before is not None and number < before:
                remove(self.spark, f"{self.folder}/open/{name}")
        if before is None or (batch_id + 1) % self.merge_every:
            return
        closed = [n for n in entries if n <= before and (base is None or n > base)]
        if not closed:
            return
        parts = [self._read(f"closed/batch={n}") for n in closed]
        if base is not None:
            parts.append(self._read(f"base/batch={base}"))
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        # Up to the batch before: this one may be delivered again.
        whole.write.mode("overwrite").parquet(f"{self.folder}/base/batch={before}")
        make_folder(self.spark, f"{self.folder}/bases/{before:012d}")
        if base is None:
            return
        for name in folder_names(self.spark, f"{self.folder}/log"):
            number = int(name.split("_")[0])
            if number <= base:
                remove(self.spark, f"{self.folder}/closed/batch={number}")
                remove(self.spark, f"{self.folder}/log/{name}")
