"""Delivering streams: append tables, replaced tables, waiting, progress."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from ..session import work_path


def _timed(writer: DataStreamWriter, every: str | None) -> DataStreamWriter:
    """A processing-time trigger, or, with None, all that is there and then stop."""
    return writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)


def append_table(
    stream: DataFrame, folder: str, every: str | None = "20 seconds", name: str | None = None
) -> StreamingQuery:
    """Append to Parquet files under ``folder``, exactly once across restarts."""
    writer = stream.writeStream.outputMode("append").format("parquet")
    writer = writer.option("path", f"{folder}/table").option(
        "checkpointLocation", f"{folder}/checkpoint"
    )
    if name:
        writer = writer.queryName(name)
    return _timed(writer, every).start()


def memory_table(stream: DataFrame, name: str, every: str | None = "20 seconds") -> StreamingQuery:
    """A named table in driver memory. For looking at small streams only."""
    writer = stream.writeStream.queryName(name).outputMode("append").format("memory")
    return _timed(writer, every).start()


def each_batch(
    stream: DataFrame,
    deliver: Callable[[DataFrame, int], None],
    folder: str,
    every: str | None = "20 seconds",
    mode: str = "append",
    name: str | None = None,
) -> StreamingQuery:
    """Call ``deliver(batch, batch_id)`` for every micro-batch. After a failure a batch may
    be delivered again under the same id, so ``deliver`` has to overwrite by id."""
    writer = stream.writeStream.outputMode(mode).foreachBatch(deliver)
    writer = writer.option("checkpointLocation", f"{folder}/checkpoint")
    if name:
        writer = writer.queryName(name)
    return _timed(writer, every).start()


def replaced_table(
    stream: DataFrame, folder: str, every: str | None = "20 seconds", mode: str = "complete"
) -> StreamingQuery:
    """For running aggregates: every micro-batch writes the whole (small) result under its id."""

    def deliver(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/table/batch={batch_id}")

    return each_batch(stream, deliver, folder, every, mode)


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """The result of the last micro-batch of a replaced table."""
    table = spark.read.parquet(f"{folder}/table")
    last = table.agg(F.max("batch")).first()[0]
    return table.filter(F.col("batch") == last).drop("batch")


def finish(query: StreamingQuery) -> None:
    """Wait for a run over all available input; its failure is raised here."""
    query.awaitTermination()


def follow(query: StreamingQuery, show: Callable[[], None], seconds: float = 20.0) -> None:
    """Call ``show`` every so many seconds while the query is alive; an interrupt stops the
    query, its failure is raised here."""
    try:
        while not query.awaitTermination(seconds):
            show()
    except KeyboardInterrupt:
        query.stop()


def is_alive(query: StreamingQuery) -> bool:
    return query.isActive


def rows_read(query: StreamingQuery) -> int:
    """Rows taken in so far, as far back as Spark keeps progress records."""
    return sum(p["numInputRows"] for p in query.recentProgress)


def count_intake(frame: DataFrame, name: str = "intake") -> DataFrame:
    """Report the number of rows passing this point, at no extra pass."""
    return frame.observe(name, F.count(F.lit(1)).alias("rows"))


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all available input into a table in the shared folder."""
    spark = stream.sparkSession
    folder = work_path(spark, name)
    if mode == "append":
        finish(append_table(stream, folder, every=None))
        return spark.read.schema(stream.schema).parquet(f"{folder}/table")
    finish(replaced_table(stream, folder, every=None, mode=mode))
    return latest(spark, folder)
