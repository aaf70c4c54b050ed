"""Connected components of a graph in Spark, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep

MAX_ROUNDS = 64


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of any comparable type to (node, root): root is the smallest node reachable.

    Nodes without an edge don't appear. Self-loops and repeated edges are allowed; null ends are
    ignored. Each round is written to the shared folder; the number of rounds grows with the
    logarithm of the longest path. The work of a round is aggregation (combined in the map tasks)
    and a join on the node; a node never has all its neighbours in one row.
    """
    pairs = edges.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    now = keep(_down(pairs), "components")
    for _ in range(MAX_ROUNDS):
        before = _state(now)
        if not before[0]:
            break
        now = keep(_down(_large_star(now)), "components")
        now = keep(_small_star(now), "components")
        if _state(now) == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    ).groupBy("node").agg(F.min("root").alias("root"))


def _down(pairs: DataFrame) -> DataFrame:
    """Each edge once, from its larger end ``a`` to its smaller end ``b``."""
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()


def _state(edges: DataFrame) -> tuple:
    h = F.xxhash64("a", "b")
    row = edges.agg(
        F.count(F.lit(1)),
        F.sum(F.shiftrightunsigned(h, 32)),
        F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))),
    ).first()
    return tuple(x or 0 for x in row)


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n"))
    linked = both.join(least.select("a", "m"), "a").filter("b > a")
    return linked.select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Links every smaller neighbour of a node, and the node, to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    linked = edges.join(least, "a")
    return _down(linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))))
