"""Vocabulary: fitting, encoding, word vectors, pooling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.fixed_values import SEQUENCE_LENGTH, VECTOR_VOCABULARY_LIMIT
from .blocks import number_texts
from .counts import chunks, places_in_rows, split_words
from .lookup import look_up
from .numbering import number_rows

#: Vectors of so many words may be broadcast (64 dimensions: about 30 MB).
BROADCAST_WORDS = 100_000
_POSITION_RANGE = 4294967296  # more than an array can hold
_BATCH_ROWS = 1 << 16


def tokens(docs: DataFrame, key: str, text: str, keep_empty: bool = False) -> DataFrame:
    """One row per vocabulary word: key, pos, word. ``keep_empty`` keeps a row with
    NULL word for texts without words."""
    generate = F.posexplode_outer if keep_empty else F.posexplode
    return docs.select(key, generate(X.vocabulary_words(text)).alias("pos", "word"))


def _first_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, n, key, pos: the count of each word of a chunk and its first place there; no key if it has none."""
    for chunk in chunks(batches, "line"):
        words, rows = split_words(chunk["line"], " ")
        if not len(words):
            continue
        coded = words.dictionary_encode()
        codes = coded.indices.to_numpy()
        keys = chunk["key"].combine_chunks()
        distinct, ranks = np.unique(keys.fill_null(0).to_numpy(), return_inverse=True)
        ranks = np.where(keys.is_valid().to_numpy(zero_copy_only=False), ranks, len(distinct))
        places = places_in_rows(rows)
        span = places.max() + 1
        first = np.full(len(coded.dictionary), np.iinfo(np.int64).max)
        np.minimum.at(first, codes, ranks[rows] * span + places)
        rank, pos = np.divmod(first, span)
        key = pa.array(np.append(distinct, 0)[rank], pa.int64(), mask=rank == len(distinct))
        table = pa.table({"word": coded.dictionary, "n": np.bincount(codes), "key": key, "pos": pos})
        yield from table.to_batches(max_chunksize=_BATCH_ROWS)


def fit_vocabulary(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Words numbered from 1 by falling count, ties by first appearance in key order
    (``key`` is an integer that orders the documents). Columns: word, n, idx.

    Counts and first places are combined by chunks of whole texts before the shuffle. The first
    place is one decimal (document, then position): unlike a struct it keeps the
    aggregation in a hash table.
    """
    lines = docs.select(F.col(key).cast("bigint").alias("key"), X.vocabulary_line(text).alias("line"))
    base = F.col("key").cast("decimal(20,0)") * F.lit(_POSITION_RANGE).cast("decimal(10,0)")
    place = (base.cast("decimal(38,0)") + F.col("pos").cast("decimal(10,0)")).cast("decimal(38,0)")
    words = (
        lines.mapInArrow(_first_seen, "word string, n bigint, key bigint, pos bigint")
        .groupBy("word")
        .agg(F.sum("n").alias("n"), F.min(place).alias("first_place"))
    )
    ranked = number_rows(words, [F.desc("n"), F.asc("first_place")], "idx")
    return ranked.select("word", "n", "idx")


def known_ids(
    docs: DataFrame,
    vocabulary: DataFrame,
    key: str,
    text: str,
    budget: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Word numbers of each text in order, unknown words dropped. Columns: key, ids.
    ``key`` is unique; texts without a known word have an empty list.

    Numbers are gathered into lists in the map tasks, so what is shuffled is one compact
    list a document, not a row a word. A group is one document.
    """
    found = look_up(
        tokens(docs, key, text, keep_empty=True),
        vocabulary,
        ["idx"],
        salt_from=[key, "pos"],
        budget=budget,
        limit=limit,
    )
    # The list skips NULLs, so only known words travel to the document's task.
    known = F.when(
        F.col("idx").isNotNull(),
        F.struct(F.col("pos"), F.col("idx").cast("int").alias("idx")),
    )
    lists = found.groupBy(key).agg(F.collect_list(known).alias("known"))
    return lists.select(key, F.transform(F.array_sort("known"), lambda p: p["idx"]).alias("ids"))


def ids_by_block(
    docs: DataFrame, vocabulary: DataFrame, key: str, text: str, budget: int | None = None
) -> DataFrame:
    """``known_ids`` for large inputs, the same rows. Texts stay whole (``blocks.number_texts``): a block asks
    for the numbers of its distinct words. A vocabulary of at most ``budget`` bytes is broadcast."""
    table = vocabulary.select("word", "n", F.col("idx").cast("int").alias("idx"))
    return number_texts(docs, key, text, X.vocabulary_words(text), table, "idx", "ids", budget=budget)


def encode(
    docs: DataFrame,
    vocabulary: DataFrame,
    key: str,
    text: str,
    length: int = SEQUENCE_LENGTH,
    budget: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """The last ``length`` known word numbers of each text, zeros in front. Columns: key,
    encoded. Texts without a known word come out as all zeros. A vocabulary of at most ``budget`` bytes
    is broadcast; ``limit`` has no effect any more: words aren't split by frequency."""
    ids = ids_by_block(docs, vocabulary, key, text, budget)
    return ids.select(key, pad_front("ids", length).alias("encoded"))


def pad_front(ids, length: int = SEQUENCE_LENGTH):
    """Keep the last ``length`` numbers and put zeros in front of shorter lists."""
    ids = F.col(ids) if isinstance(ids, str) else ids
    return F.slice(F.concat(F.array_repeat(F.lit(0), length), ids), -length, length)


def embedding_matrix(
    vocabulary: DataFrame,
    vectors: DataFrame,
    dimension: int,
    limit: int | None = VECTOR_VOCABULARY_LIMIT,
    padding: bool = False,
) -> DataFrame:
    """One vector a vocabulary word: from ``vectors`` (word, vec) where it has the word and
    the word's number is below ``limit`` (None: whatever its number), zeros otherwise. Of a
    word with several vectors the largest counts, compared element by element. Columns: idx,
    word, vec. ``padding`` adds number 0 without a word, all zeros: what fills short sequences.

    Up to BROADCAST_WORDS words are broadcast to the (large) vector table, and the vectors found
    to the vocabulary; more are joined by shuffle.
    """
    wanted = vocabulary.select("word", "idx")
    if limit is not None:
        wanted = wanted.filter(F.col("idx") < limit)
    found = vectors.join(_small(wanted, limit), "word").groupBy("idx").agg(F.max("vec").alias("vec"))
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dimension)
    matrix = vocabulary.join(_small(found, limit), "idx", "left").select(
        "idx", "word", F.coalesce("vec", zeros).alias("vec")
    )
    if padding:
        zero = vocabulary.sparkSession.range(1).select(
            F.col("id").alias("idx"), F.lit(None).cast("string").alias("word"), zeros.alias("vec")
        )
        matrix = matrix.unionByName(zero)
    return matrix


def _small(rows: DataFrame, limit: int | None) -> DataFrame:
    """Marked for broadcast if ``limit`` bounds its rows well enough."""
    return F.broadcast(rows) if limit is not None and limit <= BROADCAST_WORDS else rows


def _pooled(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = shared.value
        limit, dimension = vectors.shape
        for batch in batches:
            ids = batch.column("ids")
            places, ends = ids.flatten().to_numpy(), np.cumsum(ids.value_lengths().to_numpy())
            places = np.where(places < limit, places, 0)
            mean, most = np.zeros((2, len(batch), dimension))
            sizes = np.diff(ends, prepend=0)
            for row, (size, end) in enumerate(zip(sizes, ends)):
                if size:  # distinct words, so that a long text needs no more than the vectors themselves
                    found, times = np.unique(places[end - size : end], return_counts=True)
                    mine = vectors[found].astype(np.float64)
                    mean[row], most[row] = times @ mine / size, np.fmax.reduce(mine)
            offsets = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * dimension)
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.ravel())) for x in (mean, most)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(sizes.astype(np.int64)), *lists], names=["key", "n_words", "mean", "max"]
            )

    return run


def _pooled_in_rows(ids: DataFrame, matrix: DataFrame, key: str, dimension: int, limit: int) -> DataFrame:
    rows = matrix.filter((F.col("idx") < limit) & F.col("vec").isNotNull()).select("idx", "vec").toArrow()  # at most ``limit``
    vectors = np.zeros((max(limit, 1), dimension), np.float64)
    if len(rows):
        flat = rows["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        vectors = vectors.astype(flat.dtype)
        vectors[rows["idx"].to_numpy()] = flat.reshape(len(rows), dimension)
    shared = ids.sparkSession.sparkContext.broadcast(vectors)
    kind = ids.schema[key].dataType.simpleString()
    done = ids.select(F.col(key).alias("key"), "ids").mapInArrow(
        _pooled(shared), f"key {kind}, n_words bigint, mean array<double>, max array<double>"
    )
    return done.select(F.col("key").alias(key), "n_words", "mean", "max")


def pool_vectors(
    docs: DataFrame,
    vocabulary: DataFrame,
    matrix: DataFrame,
    key: str,
    text: str,
    dimension: int,
    limit: int | None = VECTOR_VOCABULARY_LIMIT,
) -> DataFrame:
    """Mean and maximum, per dimension, of the vectors of all known words of a text;
    zeros for texts without one. Columns: key, n_words, mean, max.

    Numbers are gathered per document first. Words numbered ``limit`` or more have zero vectors. Up to
    BROADCAST_WORDS vectors are broadcast and pooled in the document's row; with a larger ``limit``, or
    None, each distinct word of a document meets its vector in a join that is Spark's choice by size.
    """
    ids = ids_by_block(docs, vocabulary, key, text)
    if limit is not None and limit <= BROADCAST_WORDS:
        return _pooled_in_rows(ids, matrix, key, dimension, limit)
    slot = F.col("idx") if limit is None else F.when(F.col("idx") < limit, F.col("idx")).otherwise(F.lit(0))
    counted = (
        ids.select(key, F.size("ids").cast("bigint").alias("n_words"), F.explode_outer("ids").alias("idx"))
        .groupBy(key, "n_words", slot.alias("slot"))
        .agg(F.count("*").alias("times"))
    )
    if limit is not None:
        matrix = matrix.filter(F.col("idx") < limit)
    bounded = matrix.select(
        F.col("idx").cast("int").alias("slot"), array_to_vector("vec").alias("v")
    )
    zeros = array_to_vector(F.array_repeat(F.lit(0.0), dimension))
    weighted = counted.join(_small(bounded, limit), "slot", "left").select(
        key, "n_words", "times", F.coalesce("v", zeros).alias("v")
    )
    summary = Summarizer.metrics("mean", "max").summary(F.col("v"), F.col("times").cast("double"))
    return (
        weighted.groupBy(key, "n_words")
        .agg(summary.alias("s"))
        .select(
            key,
            "n_words",
            vector_to_array("s.mean").alias("mean"),
            vector_to_array("s.max").alias("max"),
        )
    )
