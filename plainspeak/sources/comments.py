"""Captured comments: JSON records with user, comment and capture time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text, times
from ..operators.frames import compute_once

CAPTURED = T.StructType(
    [
        T.StructField("user", T.StringType(), True),
        T.StructField("comment", T.StringType(), True),
        T.StructField("timestamp", T.StringType(), True),
    ]
)


def project_comments(raw: DataFrame) -> DataFrame:
    """Capture time as a number and as a timestamp; malformed times become NULL.
    Columns beyond the three captured ones are kept."""
    extra = [c for c in raw.columns if c not in ("timestamp", "user", "comment")]
    epoch = times.parse_epoch("timestamp")
    return raw.select(
        *extra,
        epoch.alias("timestamp"),
        "user",
        "comment",
        times.event_time(epoch).alias("event_time"),
    )


def _schema(extra: T.StructType | None) -> T.StructType:
    return T.StructType([*CAPTURED.fields, *(extra.fields if extra else [])])


def read_comments(spark: SparkSession, path: str, extra: T.StructType | None = None) -> DataFrame:
    """``extra``: further fields of the records, kept as they are."""
    return project_comments(spark.read.schema(_schema(extra)).json(path))


def stream_comments(
    spark: SparkSession, path: str, files_per_trigger: int | None = None, extra: T.StructType | None = None
) -> DataFrame:
    """Each new file adds rows. A broken record reads as an all-NULL row, which the
    non-empty filter of the cleaning plan drops. ``extra`` as in ``read_comments``."""
    reader = spark.readStream.schema(_schema(extra))
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return project_comments(reader.json(path))


def write_comments(
    comments: DataFrame, path: str, records_per_file: int | None = None, extra: T.StructType | None = None
) -> None:
    """JSON lines, non-ASCII kept; ``records_per_file=1`` gives one file a record. Times are plain
    seconds with six decimals. ``extra`` fields are written as well."""
    stamp = F.when(F.col("timestamp").isNotNull(), F.format_string("%.6f", F.col("timestamp").cast("double")))
    writer = comments.select(
        "user", "comment", stamp.alias("timestamp"), *(extra.fieldNames() if extra else [])
    ).write.mode("append")
    if records_per_file:
        writer = writer.option("maxRecordsPerFile", records_per_file)
    writer.json(path)


def guard_blank(comments: DataFrame) -> DataFrame:
    """Strip user and comment; keep rows where both still hold something."""
    stripped = comments.withColumn("user", text.strip("user"))
    stripped = compute_once(stripped, "comment", text.strip("comment"))
    return stripped.filter((F.col("user") != "") & (F.col("comment") != "")).select(
        *comments.columns
    )


def intake_cap(comments: DataFrame, number: int, order: str = "comment_id") -> DataFrame:
    """The first ``number`` comments of an intake."""
    return comments.orderBy(order).limit(number)
