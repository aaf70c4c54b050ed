"""Mergeable summaries of fixed size: distinct users and frequent words, kept a time bucket, merged for any range.

Users: HyperLogLog sketches of 2^USER_BITS registers, standard error about 1.04 / sqrt(2^USER_BITS).
Words: frequent-items sketches. An estimated size is never below the real one and never above it by more
than the bound that comes with it; a word that is missing has at most twice the bound.
Both combine in the map tasks, and merging merged ones gives the same as one pass over the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

#: 4,096 registers: 1.6 % standard error, some 2 KB a bucket.
USER_BITS = 12
#: Words a sketch keeps counters for; the bound of its sizes is 2.625 / WORDS_TRACKED of all words.
WORDS_TRACKED = 20_000
#: 3.5 / map size is the error of the sketch a word seen; its map is filled to three quarters.
_ERROR = 3.5 * 0.75


def bucket(event_time: str = "event_time", unit: str = "minute") -> Column:
    return F.date_trunc(unit, F.col(event_time)).alias(unit)


def user_sketches(scored: DataFrame, *by: Column, user: str = "user") -> DataFrame:
    """A sketch of the users of each group, and whether some row names none (all such count as one user)."""
    return scored.groupBy(*by).agg(
        F.hll_sketch_agg(F.col(user), F.lit(USER_BITS)).alias("users"),
        F.coalesce(F.max(F.col(user).isNull()), F.lit(False)).alias("unnamed"),
    )


def count_users(sketches: DataFrame, *by: Column) -> DataFrame:
    """by, count_user: sketches merged; no sketches give zero."""
    merged = sketches.groupBy(*by).agg(
        F.hll_sketch_estimate(F.hll_union_agg("users")).alias("named"), F.max("unnamed").cast("int").alias("unnamed")
    )
    total = F.coalesce("named", F.lit(0)) + F.coalesce("unnamed", F.lit(0))
    return merged.select(*[c for c in merged.columns if c not in ("named", "unnamed")], total.alias("count_user"))


def merge_users(sketches: DataFrame, *by: Column) -> DataFrame:
    return sketches.groupBy(*by).agg(F.hll_union_agg("users").alias("users"), F.max("unnamed").alias("unnamed"))


def rolling(rows: DataFrame, days: int, start: str = "minute") -> DataFrame:
    """Each row once for every range of that many days which holds it; ``first_day`` names the range."""
    day = F.to_date(start)
    return rows.withColumn("first_day", F.explode(F.sequence(F.date_sub(day, days - 1), day)))


def word_sketches(
    scored: DataFrame, *by: Column, comment: str = "comment", tracked: int = WORDS_TRACKED
) -> DataFrame:
    """A sketch of the display words of each group, and how many words it has seen."""
    names = [f"_by{i}" for i in range(len(by))]
    words = scored.select(*by, F.explode(X.display_words(comment)).alias("_word"))
    columns = words.columns[:-1]
    words = words.toDF(*names, "_word")  # groups may be named as the results are
    sketched = words.groupBy(*names).agg(
        F.expr(f"approx_top_k_accumulate(_word, {tracked})").alias("words"), F.count("*").alias("seen")
    )
    return sketched.withColumnsRenamed(dict(zip(names, columns)))


def merge_words(sketches: DataFrame, *by: Column, tracked: int = WORDS_TRACKED) -> DataFrame:
    return sketches.groupBy(*by).agg(
        F.expr(f"approx_top_k_combine(words, {tracked})").alias("words"), F.sum("seen").alias("seen")
    )


def frequent_words(sketches: DataFrame, number: int, tracked: int = WORDS_TRACKED) -> DataFrame:
    """text, size, bound: the most frequent words over all sketches, ties in word order; ``size - bound`` or
    more is sure. At most ``tracked`` words leave the merged sketch, in one row."""
    # By a constant: no sketches then give no row, where merging nothing at all would be an error.
    merged = merge_words(sketches.filter(F.col("seen") > 0), F.lit(1).alias("all"), tracked=tracked)
    items = merged.select(
        F.explode(F.expr(f"approx_top_k_estimate(words, {tracked})")).alias("item"),
        F.ceil(F.col("seen") * F.lit(_ERROR / tracked)).alias("bound"),
    )
    return (
        items.select(F.col("item.item").alias("text"), F.col("item.count").alias("size"), "bound")
        .orderBy(F.desc("size"), "text")
        .limit(number)
    )
