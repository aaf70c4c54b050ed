"""Line-based side tables: word lists, id lists, word vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.fixed_values import VECTOR_DIMENSION


def read_stop_words(spark: SparkSession, path: str) -> DataFrame:
    """One word a line, outer quotes removed, each word once."""
    return spark.read.text(path).select(text.strip_outer_quotes("value").alias("word")).distinct()


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("id")).filter(F.col("id") != "")


def append_ids(ids: DataFrame, path: str) -> None:
    ids.select(F.col("id").cast("string")).write.mode("append").text(path)


def read_word_vectors(
    spark: SparkSession, path: str, dimension: int = VECTOR_DIMENSION
) -> DataFrame:
    """``word v1 v2 ...`` a line. Lines of another length (such as the count line
    some files start with) are dropped."""
    parts = F.split(F.rtrim("value"), " ")
    return (
        spark.read.text(path)
        .select(parts.alias("parts"))
        .filter(F.size("parts") == dimension + 1)
        .select(
            F.col("parts")[0].alias("word"),
            F.transform(
                F.slice("parts", 2, dimension), lambda v: v.try_cast("float")
            ).alias("vec"),
        )
    )
