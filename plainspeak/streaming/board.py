"""The live board: score new comments once, keep panels that add up.

For every micro-batch the board writes the scored rows and four small partial tables. A panel is a
merge of the partial tables, so no refresh reads the scored history, and the work of a micro-batch
depends on its own rows only.

A batch counts from the moment its entry is in the log, which is made after its last table. An entry
names the delivery it stands for: a repeated delivery writes beside the first one and takes its place
with its entry, so a reader sees the old state or the new one, never half of a batch.

Every so many batches the partial tables so far are merged into a base, and what the base before
replaced is removed (not yet what this one replaces: readers may be at it). A refresh reads one base
and the batches since, so neither the files it lists nor the files kept grow with the batches delivered.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions import labels, times
from ..functions.fixed_values import LABEL_NAMES, MINUTE_FORMAT, RECENT_ROWS, TOP_WORDS
from ..operators import panels
from ..session import folder_names, make_folder, remove, scratch
from . import sinks

SCORED = T.StructType(
    [
        T.StructField("timestamp", T.DoubleType()),
        T.StructField("user", T.StringType()),
        T.StructField("comment", T.StringType()),
        T.StructField("prediction", T.IntegerType()),
    ]
)
_STORED = "timestamp double, user string, comment string, prediction int, batch int, day date"
_PARTS = {
    "minutes": "minute timestamp, prediction int, n bigint",
    "users": "user string",
    "words": "text string, size bigint",
    "recent": "timestamp double, user string, comment string, prediction int",
}


class Board:
    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        score: Callable[[DataFrame], DataFrame] | None = None,
        merge_every: int = 100,
    ) -> None:
        """``score`` turns a micro-batch into rows of SCORED; None for scored input."""
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.score = score or (lambda batch: batch)
        self.merge_every = merge_every

    def start(self, stream: DataFrame, every: str | None = "20 seconds") -> StreamingQuery:
        return sinks.each_batch(stream, self.deliver, self.folder, every)

    def deliver(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id and batch_id % self.merge_every == 0:
            self.merge_before(batch_id)
        base = self._base()
        if base is not None and batch_id <= base:
            return  # delivered and merged before
        entry = self._entry("batch", batch_id)
        path = f"{self.folder}/scored/batch={batch_id}"
        with scratch(spark):  # what scoring stores is gone with the batch
            day = F.to_date(times.event_time("timestamp"))
            scored = self.score(batch).select(*[F.col(f.name).cast(f.dataType) for f in SCORED])
            # A day's rows go to few files however many tasks hold some of them; a large day is split.
            scored.withColumn("day", day).hint("rebalance", "day").write.mode("overwrite").partitionBy("day").parquet(path)

        # Read back what was written: scoring runs once, and each table below reads only
        # the columns it needs.
        rows = spark.read.schema(SCORED).parquet(path)
        minute = F.date_trunc("minute", times.event_time("timestamp"))
        parts = {
            "minutes": rows.groupBy(minute.alias("minute"), "prediction").agg(F.count("*").alias("n")),
            "users": rows.select("user").distinct(),
            "words": panels.word_counts(rows),
            "recent": _last(rows),
        }
        for name, part in parts.items():
            part.write.parquet(f"{self.folder}/parts/{entry}/{name}")
        make_folder(self.spark, f"{self.folder}/log/{entry}")

    def scored(self) -> DataFrame:
        """All scored rows so far, with batch and day."""
        return self.spark.read.schema(_STORED).parquet(f"{self.folder}/scored")

    @staticmethod
    def _entry(kind: str, number: int) -> str:
        return f"{kind}-{number:012d}-{time.time_ns():020d}"

    def _entries(self, kind: str) -> dict[int, str]:
        """The newest entry of each number."""
        names = [n for n in folder_names(self.spark, f"{self.folder}/log") if n.startswith(f"{kind}-")]
        return {int(n.split("-")[1]): n for n in names}

    def _base(self) -> int | None:
        return max(self._entries("base"), default=None)

    def merge_before(self, batch_id: int) -> None:
        """Merge what counts before this batch into a base. Batches are delivered one after the other, so
        those are complete."""
        upto, bases = batch_id - 1, self._entries("base")
        last = max(bases, default=None)
        if last is not None and last >= upto:
            return
        entry = self._entry("base", upto)
        for name, merge in _MERGES.items():
            merge(self.partial(name, upto)).write.parquet(f"{self.folder}/parts/{entry}/{name}")
        make_folder(self.spark, f"{self.folder}/log/{entry}")
        if last is None:
            return
        for name in folder_names(self.spark, f"{self.folder}/parts"):
            kind, number, _ = name.split("-")
            if int(number) <= last and name != bases[last]:
                remove(self.spark, f"{self.folder}/log/{name}")
                remove(self.spark, f"{self.folder}/parts/{name}")

    def partial(self, name: str, upto: int | None = None) -> DataFrame:
        """A partial table: the base and the batches since, up to ``upto`` if given."""
        bases, batches = self._entries("base"), self._entries("batch")
        base = max(bases, default=-1)
        entries = [bases[base]] if base >= 0 else []
        entries += [e for b, e in batches.items() if b > base and (upto is None or b <= upto)]
        paths = [f"{self.folder}/parts/{e}/{name}" for e in entries]
        if not paths:
            return self.spark.createDataFrame([], _PARTS[name])
        return self.spark.read.schema(_PARTS[name]).parquet(*paths)

    def label_counts(self) -> DataFrame:
        return (
            self.partial("minutes")
            .filter(F.col("prediction").isNotNull())
            .groupBy("prediction")
            .agg(F.sum("n").alias("n"))
            .select(labels.label_name("prediction").alias("label"), "n")
        )

    def counters(self) -> DataFrame:
        """One row: count_clean, count_offensive, count_hate, count_user."""
        n = F.col("n")
        counts = self.partial("minutes").agg(
            *[
                F.coalesce(F.sum(F.when(F.col("prediction") == c, n)), F.lit(0)).alias(
                    f"count_{name.lower()}"
                )
                for c, name in LABEL_NAMES.items()
            ]
        )
        users = panels.distinct_users(self.partial("users"))
        # Both sides are a single aggregate row.
        return counts.withColumn("one", F.lit(1)).join(
            users.withColumn("one", F.lit(1)), "one"
        ).drop("one")

    def label_by_minute(self) -> DataFrame:
        return (
            self.partial("minutes")
            .filter(F.col("minute").isNotNull() & F.col("prediction").isNotNull())
            .groupBy("minute")
            .agg(
                *[
                    F.coalesce(F.sum(F.when(F.col("prediction") == c, F.col("n"))), F.lit(0)).alias(
                        name.lower()
                    )
                    for c, name in LABEL_NAMES.items()
                ]
            )
        )

    def recent(self) -> DataFrame:
        """The last ten over all batches are among the last ten of each."""
        return panels.recent_comments(self.partial("recent"))

    def recent_rows(self) -> DataFrame:
        """The same rows with their time stamp, in no order."""
        return panels.time_labels(_last(self.partial("recent")))

    def top_words(self, number: int = TOP_WORDS) -> DataFrame:
        return (
            self.partial("words")
            .groupBy("text")
            .agg(F.sum("size").alias("size"))
            .orderBy(F.desc("size"), "text")
            .limit(number)
        )

    def snapshot(self) -> DataFrame:
        """panel, records: each small panel as one JSON array."""
        parts = {
            "labels": panels.records(self.label_counts(), ["label", "n"], [-F.col("n"), F.col("label")]),
            "counters": panels.records(
                self.counters(),
                ["count_clean", "count_offensive", "count_hate", "count_user"],
                [F.lit(0)],
            ),
            "minutes": panels.records(
                self.label_by_minute().withColumn("date_time", F.date_format("minute", MINUTE_FORMAT)),
                ["date_time", "clean", "offensive", "hate"],
                [F.col("minute")],
            ),
            # recent() is ten rows, oldest first; their place orders the records.
            "recent": panels.records(
                self.recent_rows(),
                ["date", "time", "user", "comment", "label"],
                [F.col("timestamp"), F.col("user"), F.col("comment")],
            ),
            "words": panels.records(self.top_words(), ["text", "size"], [-F.col("size"), F.col("text")]),
        }
        out = None
        for panel, rows in parts.items():
            rows = rows.select(F.lit(panel).alias("panel"), "records")
            out = rows if out is None else out.unionByName(rows)
        return out


def _last(rows: DataFrame, number: int = RECENT_ROWS) -> DataFrame:
    return (
        rows.filter(F.col("timestamp").isNotNull())
        .orderBy(F.desc("timestamp"), F.desc("user"), F.desc("comment"))
        .limit(number)
    )


_MERGES = {
    "minutes": lambda rows: rows.groupBy("minute", "prediction").agg(F.sum("n").alias("n")),
    "users": lambda rows: rows.distinct(),
    "words": lambda rows: rows.groupBy("text").agg(F.sum("size").alias("size")),
    "recent": _last,
}
