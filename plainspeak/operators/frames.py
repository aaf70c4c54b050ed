"""Small helpers on whole frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that later filters read without computing it again.

    Catalyst copies an expression into every filter it pushes below the projection,
    so a chain of regular expressions would run once for the filter and once for the
    output. Filters do not move below a generator, so the value is produced by one
    over a single-element array. It is row-wise, without shuffle, and works on streams.
    """
    others = [c for c in df.columns if c != name]
    return df.select(*others, F.explode(F.array(value)).alias(name))


def spread(df: DataFrame, key: str, like: DataFrame | None = None) -> DataFrame:
    """Give a small input one task per core; leave large inputs alone.

    An input with no more scan tasks than the cluster has cores (for instance one file
    with one row group) would keep most cores idle in the text work that follows. Hash
    partitioning on the row key also serves a later grouping by that key. An input
    with more scan tasks than cores is returned as it is, without a shuffle.

    A stream has no scan tasks before it runs: ``like`` is a batch read of the same input
    to count them from. Without it a stream is returned as it is.
    """
    scan = df if like is None else like
    if scan.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() > cores:
        return df
    return df.repartition(cores, key)


def is_live(df: DataFrame) -> bool:
    return df.isStreaming


def is_empty(df: DataFrame) -> bool:
    """True when there is no row; reads no more than it needs to find one."""
    return df.isEmpty()
