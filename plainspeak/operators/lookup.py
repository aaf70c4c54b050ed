"""Looking up words of a token table in a word table.

Word frequencies are skewed: one word may hold a large part of all tokens. A plain
shuffle join would send all of them to one task, and a plain broadcast join fails when
the word table is large. So the size of the word table is measured first:

* a table of at most ``BROADCAST_BYTES`` is broadcast;
* of a larger one the frequent words, by counting at most ``FREQUENT_LIMIT`` short words,
  are broadcast. Tokens found there, and NULL ones, are done. Only the others take part in a
  shuffle join, salted on both sides, so that a word that is frequent among the tokens but
  not in the table is spread over tasks too. (Spark's adaptive skew join splits what is
  still uneven.) Tokens are read once for each of the two parts; nothing else is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 32 * 1024 * 1024
ROW_BYTES = 24  # beside the word itself
FREQUENT_LIMIT = 100_000
FREQUENT_LENGTH = 64
LEAST_SALTS, MOST_SALTS = 8, 64  # by the number of shuffle partitions


def split_by_frequency(
    words: DataFrame, word: str = "word", count: str = "n", budget: int | None = None,
    limit: int | None = None, values: tuple[str, ...] = (),
) -> tuple[DataFrame, DataFrame | None]:
    """Split a table of distinct words into a part to broadcast and the rest.

    A word is frequent if it holds at least ``1/limit`` of all counts, so there are at
    most ``limit`` frequent words, whatever the distribution. The rest is None when the
    whole table, its ``values`` included, is small enough. Words without a count are rare.
    """
    budget = BROADCAST_BYTES if budget is None else budget
    limit = FREQUENT_LIMIT if limit is None else limit
    size, total = words.agg(
        F.sum(
            sum(
                [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in (word, *values)],
                F.lit(ROW_BYTES),
            )
        ),
        F.sum(count),
    ).first()
    if (size or 0) <= budget:
        return words, None
    short = F.octet_length(word) <= FREQUENT_LENGTH
    often = F.col(count).cast("double") * F.lit(float(limit)) >= F.lit(float(total or 0))
    frequent = F.coalesce(short & often & F.lit(bool(total)), F.lit(False))
    return words.filter(frequent), words.filter(~frequent)


def look_up(
    tokens: DataFrame,
    words: DataFrame,
    values: list[str],
    key: str = "word",
    word: str = "word",
    count: str = "n",
    salt_from: list[str] | None = None,
    budget: int | None = None,
    limit: int | None = None,
    salts: int | None = None,
) -> DataFrame:
    """Left-join ``values`` of ``words`` (one row a word) to ``tokens``.

    Tokens that are NULL or not in the table get NULL values and are kept. ``words`` is
    read to measure it, so it should be a stored table.
    ``salt_from`` names the token columns the salt is made of; by default all of them.
    """
    if salts is None:
        partitions = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        salts = min(MOST_SALTS, max(LEAST_SALTS, partitions // 16))
    frequent, rare = split_by_frequency(words, word, count, budget, limit, tuple(values))
    first = frequent.select(
        F.col(word).alias("__key"), *[F.col(v).alias(f"__f_{v}") for v in values]
    )
    found = tokens.join(
        F.broadcast(first), F.col(key) == F.col("__key"), "left"
    )
    out = [*tokens.columns, *[F.col(f"__f_{v}").alias(v) for v in values]]
    if rare is None:
        return found.select(*out)

    missing = F.col("__key").isNull() & F.col(key).isNotNull()
    spread = F.xxhash64(*(salt_from or tokens.columns))
    left = found.filter(missing).withColumn("__salt", F.pmod(spread, F.lit(salts)))
    second = rare.select(
        F.col(word).alias("__rare_word"),
        *[F.col(v).alias(f"__r_{v}") for v in values],
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")).alias("__rare_salt"),
    )
    # The rest is larger than what may be broadcast, whatever its estimate says.
    joined = left.join(
        second.hint("merge"),
        (F.col(key) == F.col("__rare_word")) & (F.col("__salt") == F.col("__rare_salt")),
        "left",
    )
    return found.filter(~missing).select(*out).unionByName(
        joined.select(*tokens.columns, *[F.col(f"__r_{v}").alias(v) for v in values])
    )
