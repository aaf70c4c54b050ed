"""Words and pairs of neighbouring words counted in whole texts.

A row a word and a row a pair, grouped in the map tasks, fill hash tables that grow with the task's input, then spill.
Here a task counts its texts by chunks of some CHUNK_BYTES, so its memory does not depend on its input. The distinct terms
of a chunk are dealt into buckets by their hash, one row a bucket, and Spark brings the rows of a bucket together.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text counted at once, about; a text is never divided.
CHUNK_BYTES = 16 << 20
#: Bytes of text a bucket, about.
BUCKET_BYTES = 16 << 20
#: The term that counts all words; no word is empty.
ALL = ""


def chunks(batches: Iterable[pa.RecordBatch], column: str, most: int | None = None) -> Iterator[pa.Table]:
    """Rows of a task by chunks of about ``most`` bytes (CHUNK_BYTES) in ``column``."""
    most = CHUNK_BYTES if most is None else most
    waiting: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        step = max(1, len(batch) * most // max(1, batch.column(column).nbytes))
        for start in range(0, len(batch), step):
            part = batch.slice(start, step)
            waiting.append(part)
            size += part.column(column).nbytes
            if size >= most:
                yield pa.Table.from_batches(waiting)
                waiting, size = [], 0
    if waiting:
        yield pa.Table.from_batches(waiting)


def split_words(texts: pa.ChunkedArray, separator: str | None = None) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts one after the other, no empty ones, with the row each is in. Words end at ``separator``,
    or at Unicode white space as in ``functions.text.words``."""
    held = texts.combine_chunks()
    if separator is None:
        try:
            held.validate(full=True)
        except pa.ArrowInvalid:  # bytes that are no UTF-8
            held = pa.array([x and x.decode("utf-8", "replace") for x in held.cast(pa.binary()).to_pylist()], pa.string())
        lists = pc.utf8_split_whitespace(held)
    else:
        lists = pc.split_pattern(held, separator)
    words = lists.flatten()
    rows = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).fill_null(0).to_numpy())
    filled = pc.not_equal(words, "")
    return words.filter(filled), rows[filled.to_numpy(zero_copy_only=False)]


def places_in_rows(rows: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... for the words of each row."""
    sizes = np.bincount(rows)
    return np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _counted(pairs: bool, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text"):
            words, rows = split_words(chunk["text"])
            coded = words.dictionary_encode()
            codes, known = coded.indices.to_numpy().astype(np.int64), coded.dictionary
            hashes = pd.util.hash_array(known.to_numpy(zero_copy_only=False), categorize=False)
            terms, counts, places = [pa.array([ALL], pa.string())], [[len(codes)]], [np.zeros(1, np.uint64)]
            if len(known):
                terms.append(known)
                counts.append(np.bincount(codes))
                places.append(hashes)
            if pairs:
                beside = (codes[:-1] * len(known) + codes[1:])[rows[:-1] == rows[1:]]
                beside, times = np.unique(beside, return_counts=True)
                a, b = np.divmod(beside, max(1, len(known)))
                terms.append(pc.binary_join_element_wise(known.take(pa.array(a)), known.take(pa.array(b)), " "))
                counts.append(times)
                places.append(hashes[a] * np.uint64(31) + hashes[b])
            bucket = (np.concatenate(places) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            numbers, starts = np.unique(bucket[order], return_index=True)
            ends = [*starts[1:], len(order)]
            ordered = pa.concat_arrays(terms).take(pa.array(order))
            sizes = np.concatenate(counts).astype(np.int32)[order]
            lists = pa.ListArray.from_arrays(pa.array([*starts, len(order)], pa.int32()), ordered)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(numbers), pc.binary_join(lists, "\n"),  # no word has a line's end
                    pa.array([sizes[i:j].tobytes() for i, j in zip(starts, ends)], pa.binary()),
                ],
                names=["bucket", "terms", "counts"],
            )

    return run


def _added(least: int):
    def run(bucket: pa.Table) -> pa.Table:
        terms = pc.split_pattern(bucket["terms"], "\n").combine_chunks().flatten().dictionary_encode()
        counts = np.frombuffer(b"".join(bucket["counts"].to_pylist()), np.int32)
        sums = np.bincount(terms.indices.to_numpy(), counts).astype(np.int64)
        table = pa.table({"term": terms.dictionary, "n": sums})
        return table.filter(pa.array((sums >= least) | pc.equal(terms.dictionary, ALL).to_numpy(zero_copy_only=False)))

    return run


def count_terms(docs: DataFrame, text: str, pairs: bool = False, least: int = 1) -> DataFrame:
    """term, n: the count of every word (``functions.text.words``), with ``pairs`` also of every pair of neighbours in a
    text, joined by a blank, if it is ``least`` or more, and of all words together, as ``ALL``."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES + 1)
    counted = docs.select(F.col(text).alias("text")).mapInArrow(
        _counted(pairs, buckets), "bucket int, terms string, counts binary"
    )
    return counted.groupBy("bucket").applyInArrow(_added(least), "term string, n bigint")
