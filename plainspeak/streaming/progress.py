"""Progress of streaming queries as a table: one row a micro-batch, kept after the session."""

from __future__ import annotations

import threading
from types import TracebackType

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

SCHEMA = "query string, run string, batch bigint, started timestamp, rows bigint, seconds double"


class ProgressLog(StreamingQueryListener):
    """Listens while it is open (``with ProgressLog(spark, folder) as log``) to queries of the given names, or all.

    Rows are kept on the driver until ``flush_every`` of them are there, or a query ends; each is a
    few numbers of a whole micro-batch. Spark also reports while a query is idle: those reports name no new rows
    and are left out.
    """

    def __init__(
        self, spark: SparkSession, folder: str, names: set[str] | None = None, flush_every: int = 100
    ) -> None:
        self.spark = spark
        self.folder = folder
        self.names = names
        self.flush_every = flush_every
        self._rows: list[tuple] = []
        self._ended: set[str] = set()
        self._change = threading.Condition()

    def __enter__(self) -> ProgressLog:
        self.spark.streams.addListener(self)
        return self

    def __exit__(
        self, kind: type[BaseException] | None, error: BaseException | None, trace: TracebackType | None
    ) -> None:
        self.spark.streams.removeListener(self)
        self.flush()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        report = event.progress
        if not report.numInputRows or (self.names is not None and report.name not in self.names):
            return
        row = (
            report.name, str(report.runId), report.batchId, report.timestamp, report.numInputRows,
            report.durationMs.get("triggerExecution", 0) / 1000,
        )
        with self._change:
            self._rows.append(row)

    def onQueryTerminated(self, event) -> None:
        with self._change:
            self._ended.add(str(event.runId))
            self._change.notify_all()

    def wait(self, query: StreamingQuery, seconds: float = 60.0) -> None:
        """Until all reports of a query that has ended are in: they come by an event queue of their own."""
        run = str(query.runId)
        with self._change:
            if not self._change.wait_for(lambda: run in self._ended, seconds):
                raise TimeoutError(f"no end of run {run} reported")
        self.flush()

    def flush(self) -> None:
        with self._change:
            rows, self._rows = self._rows, []
        if rows:
            fields = SCHEMA.replace("started timestamp", "started string")
            frame = self.spark.createDataFrame(rows, fields).withColumn("started", F.to_timestamp("started"))
            frame.coalesce(1).write.mode("append").parquet(self.folder)

    def table(self) -> DataFrame:
        """All reports flushed so far. A batch that was run again after a failure has a row a run."""
        return self.spark.read.schema(SCHEMA).parquet(self.folder)
