"""Exact duplicates by skew-safe combining.

Texts are equal when they are identical after each run of white space became one space. Copies are
combined in three steps, each of which groups by the digest AND the full content, so two texts that
share a digest never merge:

1. within each map task (Spark's partial aggregation),
2. per digest and salt, the salt being the number of the map task modulo ``salts``: a text that fills
   a third of the table is one row a map task here, dealt over ``salts`` tasks,
3. the at most ``salts`` winners of a text.

Only expressions of Spark SQL are used; no Python touches a row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, keep, left_join_by_key, whole_text

SALTS = 16


def normalised(text: str | Column = "text") -> Column:
    return F.regexp_replace(whole_text(text), r"[\x20\x09-\x0D]+", " ")


def sha256(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = SALTS,
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, digest.

    - keep_id is the smallest id of the rows with an equal text; null texts count as empty ones, and
      all empty texts are equal to each other (but not to a text of white space, which becomes " ").
    - Repeated rows (the same id twice) each get their row and count in group_size; each of them is
      ``kept`` if its id is the group's smallest.
    - A null id is never the smallest while another exists; in a group of null ids only, keep_id is
      null and kept is true.
    - An empty table gives an empty result. Other columns of ``docs`` are ignored, whatever their names.
    - ``digest`` may be weak: texts that share a digest are told apart by their content.
    """
    plain = docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("content"))
    rows = plain.withColumn("digest", digest(F.col("content")))
    winners = (
        rows.withColumn("salt", F.spark_partition_id() % F.lit(salts))
        .groupBy("digest", "salt", "content")
        .agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .groupBy("digest", "content")
        .agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    )
    found = keep(winners.select("digest", "keep_id", "group_size"), "exact-winners")
    light = keep(rows.select("id", "digest"), "exact-rows")
    several = found.groupBy("digest").count().filter("count > 1").select("digest")
    if several.isEmpty():
        out = left_join_by_key(light, found, "digest", "group_size")
    else:  # digests that stand for several texts: their rows look up the winner by content
        several = keep(several, "exact-collisions")
        alone = keep(light.join(several, "digest", "left_anti"), "exact-alone")
        shared = winners.join(several, "digest", "left_semi")
        out = left_join_by_key(
            alone, found.join(several, "digest", "left_anti"), "digest", "group_size"
        ).unionByName(rows.join(shared, ["digest", "content"]).drop("content"))
    return out.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "digest",
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each text, all columns kept: the one with the text's smallest id.

    Of rows that repeat id and text one stays; rows that share an id only are judged by their texts. A
    text that occurs without an id only stays with one such row.
    """
    kept = exact_duplicates(docs, id_col, text_col).filter("kept")
    name, mine = fresh("id", docs.columns), fresh("digest", docs.columns)
    theirs = f"of_{mine}"
    kept = kept.select(F.col(id_col).alias(f"of_{name}"), F.col("digest").alias(theirs)).distinct()
    marked = docs.withColumn(mine, sha256(normalised(text_col)))
    same = F.col(mine) == F.col(theirs)
    named = marked.join(kept, (F.col(id_col) == F.col(f"of_{name}")) & same, "left_semi").dropDuplicates([id_col, mine])
    unnamed = marked.filter(F.col(id_col).isNull())
    if not unnamed.isEmpty():
        lone = kept.filter(F.col(f"of_{name}").isNull())
        named = named.unionByName(unnamed.join(lone, same, "left_semi").dropDuplicates([mine]))
    return named.select(docs.columns)
