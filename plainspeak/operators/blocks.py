"""Texts rewritten with values from a large table, a block of whole texts at a time.

Taking texts apart into a row a word, looking each row up and putting the rows together again moves a multiple of
the texts and sorts it. Here texts stay whole: they are dealt into blocks of some BLOCK_BYTES by their key and shuffled
once. Each block names its distinct terms, the terms are looked up (by broadcast in a small table, by shuffle in
a larger one), and what was found goes to the block, whose texts are rewritten there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from .counts import places_in_rows, split_words
from .lookup import split_by_frequency

#: Bytes of text a block, about; a text is never divided.
BLOCK_BYTES = 1 << 20


def _terms_of(terms: Callable[[list[str]], Iterable[str]]):
    def run(block: pa.Table) -> pa.Table:
        found: set[str] = set()
        for line in block["line"].to_pylist():
            found.update(terms(line.split(" ")[1:]))
        number = block["block"][0].as_py()
        return pa.table({"block": pa.array([number] * len(found), pa.int64()), "term": pa.array(list(found), pa.string())})

    return run


def _rewritten(rewrite: Callable[[list[list[str]], dict[str, Any]], Any], kind: str):
    made = to_arrow_type(_parse_datatype_string(kind))

    def run(block: pa.Table, known: pa.Table) -> pa.Table:
        values = dict(zip(known["term"].to_pylist(), known["value"].to_pylist()))
        place: dict[Any, int] = {}
        at: list[int] = []  # rows where a key comes first
        texts: list[list[list[str]]] = []
        for row, (key, line) in enumerate(zip(block["key"].to_pylist(), block["line"].to_pylist())):
            if key not in place:
                place[key] = len(texts)
                at.append(row)
                texts.append([])
            texts[place[key]].append(line.split(" ")[1:])
        out = pa.array([rewrite(t, values) for t in texts], made)
        return pa.table([block["key"].take(pa.array(at, pa.int64())), out], names=["key", "out"])

    return run


def rewrite_texts(
    docs: DataFrame,
    key: str,
    text: str,
    words: Column,
    table: DataFrame,
    value: str,
    terms: Callable[[list[str]], Iterable[str]],
    rewrite: Callable[[list[list[str]], dict[str, Any]], Any],
    kind: str,
    name: str,
    word: str = "word",
    budget: int | None = None,
) -> DataFrame:
    """``key`` and ``name`` (of type ``kind``), one row a key.

    ``words``: the words of ``text``, without blanks in them, empty ones included. ``terms`` names what a text wants to know of ``table``
    (``word``, ``n``, ``value``; one row a word), ``rewrite`` gets the word lists of all rows of a key, with the values found.
    ``docs`` is read to measure it, so costly cleaning is best stored before. A table of at most ``budget`` bytes is broadcast.
    """
    named, done = _terms_of(terms), _rewritten(rewrite, kind)
    return _by_blocks(docs, key, text, words, table, value, named, done, kind, name, word, budget)


def _distinct_words(block: pa.Table) -> pa.Table:
    found = split_words(block["line"], " ")[0].unique()
    return pa.table({"block": pa.repeat(block["block"][0], len(found)), "term": found})


def _numbered(block: pa.Table, known: pa.Table) -> pa.Table:
    words, rows = split_words(block["line"], " ")
    places = pc.index_in(words, known["term"].combine_chunks())
    held = places.is_valid().to_numpy(zero_copy_only=False)
    numbers = known["value"].to_numpy()[places.drop_null().to_numpy()]
    keys = block["key"].combine_chunks().dictionary_encode(null_encoding="encode")
    own = keys.indices.to_numpy()[rows[held]]
    count = len(keys.dictionary)
    if count == len(block):
        order = np.argsort(own, kind="stable")
    else:  # the texts of a repeated key word by word beside one another
        order = np.lexsort((numbers, places_in_rows(rows)[held], own))
    ends = np.concatenate(([0], np.cumsum(np.bincount(own, minlength=count)))).astype(np.int32)
    ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(numbers[order], pa.int32()))
    return pa.table([keys.dictionary, ids], names=["key", "out"])


def number_texts(
    docs: DataFrame, key: str, text: str, words: Column, table: DataFrame, value: str, name: str,
    word: str = "word", budget: int | None = None,
) -> DataFrame:
    """``rewrite_texts`` for numbers: the ints ``value`` of the words of each text, in order, those without one left out.
    ``words``: no empty ones, which are left out too. A block's words are handled as Arrow columns."""
    return _by_blocks(
        docs, key, text, words, table, value, _distinct_words, _numbered, "array<int>", name, word, budget
    )


def _by_blocks(docs, key, text, words, table, value, named, rewritten, kind, name, word, budget) -> DataFrame:
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    # A blank before each word tells no word from one empty word.
    line = F.array_join(F.concat(F.array(F.lit("")), words), " ")
    lines = docs.select(F.col(key).alias("key"), F.coalesce(line, F.lit("")).alias("line"))
    block = F.pmod(F.xxhash64("key"), F.lit(size // BLOCK_BYTES + 1)).alias("block")
    dealt = lines.select(block, "key", "line").repartition("block")
    wanted = dealt.groupBy("block").applyInArrow(named, "block long, term string")
    large = split_by_frequency(table, word, budget=budget, values=(value,))[1] is not None
    values = table.select(F.col(word).alias("term"), F.col(value).alias("value"))
    known = wanted.join(values.hint("merge") if large else F.broadcast(values), "term").select("block", "term", "value")
    done = dealt.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(
        rewritten, f"key {docs.schema[key].dataType.simpleString()}, out {kind}"
    )
    return done.select(F.col("key").alias(key), F.col("out").alias(name))
