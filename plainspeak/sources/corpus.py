"""Labelled corpora."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import labels

LABELLED = T.StructType(
    [
        T.StructField("free_text", T.StringType(), True),
        T.StructField("label_id", T.StringType(), True),
    ]
)


def read_corpus(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """CSV with header, doubled quotes inside quotes and line breaks inside quotes.
    ``label_id`` comes out as int, NULL where it is not a class. With ``multi_line`` a
    file is read by one task, so a large corpus should come in many files."""
    raw = (
        spark.read.schema(LABELLED)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
        .csv(path)
    )
    return raw.withColumn("label_id", labels.parse_label("label_id"))


def keep_valid_labels(corpus: DataFrame, label: str = "label_id") -> DataFrame:
    return corpus.withColumn(label, labels.parse_label(label)).filter(F.col(label).isNotNull())


def tag_split(corpus: DataFrame, split: str) -> DataFrame:
    return corpus.withColumns({"set": F.lit(split), "counter": F.lit(1)})


def combine(*parts: DataFrame) -> DataFrame:
    """Union all by column name."""
    return reduce(lambda a, b: a.unionByName(b), parts)


def combine_by_position(first: DataFrame, second: DataFrame) -> DataFrame:
    """Union all by position, for tables with one shared explicit schema."""
    return first.union(second)
