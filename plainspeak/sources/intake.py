"""An inbox that is kept clean: lines that are no records go to a dead-letter table, files taken in to an archive."""

from __future__ import annotations

from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions import times
from ..session import move
from ..streaming import sinks
from .comments import CAPTURED

BROKEN = "broken"
FILE = "file"


def _schema(extra: T.StructType | None) -> T.StructType:
    broken = T.StructField(BROKEN, T.StringType(), True)
    return T.StructType([*CAPTURED.fields, *(extra.fields if extra else []), broken])


def stream_inbox(
    spark: SparkSession,
    inbox: str,
    archive: str | None = None,
    files_per_trigger: int | None = None,
    extra: T.StructType | None = None,
) -> DataFrame:
    """Captured comments with ``file`` and ``broken``: the line itself where it is no record or a field has
    another type, else NULL. With ``archive``, files move there when the batch after the one that read
    them is planned; the archive must be outside the inbox."""
    reader = (
        spark.readStream.schema(_schema(extra))
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", BROKEN)
        # Sub-folders as well: a job's output is a folder of files.
        .option("recursiveFileLookup", "true")
    )
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    raw = reader.json(inbox).withColumn(FILE, F.col("_metadata.file_path"))
    epoch = times.parse_epoch("timestamp")
    return raw.withColumns({"timestamp": epoch, "event_time": times.event_time(epoch)})


def take_in(
    stream: DataFrame, folder: str, every: str | None = "20 seconds", name: str | None = None
) -> StreamingQuery:
    """Records to ``folder``/table, broken lines to ``folder``/broken, a sub-folder a micro-batch: a batch that is
    delivered again replaces what it had written."""

    def deliver(batch: DataFrame, batch_id: int) -> None:
        whole = F.col(BROKEN).isNull()
        records = batch.filter(whole).drop(BROKEN)
        records.write.mode("overwrite").parquet(f"{folder}/table/batch={batch_id}")
        # All columns: Spark refuses to read the broken line alone from text it has not parsed.
        batch.filter(~whole).write.mode("overwrite").parquet(f"{folder}/broken/batch={batch_id}")

    return sinks.each_batch(stream, deliver, folder, every, name=name)


def take_all(stream: DataFrame, folder: str, archive: str | None = None) -> None:
    """Take in all that is there. Spark archives the files of a batch with the next one; those of the last batch are
    moved here, once the query has ended and the batch is committed. Empty files stay until the next batch."""
    sinks.finish(take_in(stream, folder, every=None))
    if archive is None:
        return
    spark = stream.sparkSession
    read = taken(stream, folder).select("batch", FILE).unionByName(dead_letters(stream, folder).select("batch", FILE))
    last = read.agg(F.max("batch")).first()[0]
    for row in read.filter(F.col("batch") == last).select(FILE).distinct().collect():  # names of one batch's files
        path = urlparse(row[FILE])
        move(spark, row[FILE], f"{archive.rstrip('/')}{unquote(path.path)}")


def taken(stream: DataFrame, folder: str) -> DataFrame:
    """Records so far, with their file and batch."""
    schema = stream.drop(BROKEN).schema.add("batch", T.IntegerType())
    return stream.sparkSession.read.schema(schema).parquet(f"{folder}/table")


def dead_letters(stream: DataFrame, folder: str) -> DataFrame:
    """file, broken and batch of every line that was no record."""
    schema = stream.schema.add("batch", T.IntegerType())
    return stream.sparkSession.read.schema(schema).parquet(f"{folder}/broken").select(FILE, BROKEN, "batch")
