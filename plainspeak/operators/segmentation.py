"""Compound words of any length: a unigram word model over syllables, and the best division of each text by it.

In scripts that put a blank after every syllable, a word is a run of syllables. The model is learned from the corpus:

1. Runs of up to ``longest`` syllables that occur ``least`` times are candidates (``runs``), if wherever they are cut in
   two the parts meet more than RATIO times as often as by chance (likelihood alone would join all that is frequent);
   single syllables always stay.
2. Expectation steps: each text adds up how often it is expected to hold each candidate, over all its divisions
   weighted by the model so far (forward and backward sums, many texts at once: ``divisions``); a grouped aggregation adds
   the texts up, in whole micro-counts, so that the sums don't depend on their order. Candidates of several syllables
   that are expected less than ``least`` times go.
3. A word costs minus the logarithm of its share, in whole micro-nats, so that ties are ties everywhere.

A text is divided by a Viterbi pass: the cheapest division, of equal ones the one with fewer words, then
the one whose last differing word is longer. Words are written with ``_`` between their syllables.

The model has at most ``most`` words (those that occur most often), a documented bound: it is held by the driver and
broadcast. Syllables it doesn't know cost as much as half an occurrence. Texts with ``_`` in a syllable, which may look like
a word of several, go through ``segment`` and ``expected_counts`` one by one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .counts import chunks, split_words
from .divisions import NumberedModel, expected, glued
from .runs import END, NUMBER_BYTES, frequent_runs, numbered_words, numbers_of, simple_parts

LONGEST = 4
LEAST = 5
ROUNDS = 3
RATIO = 5
MOST = 200_000
MICRO = 1_000_000
#: Bytes of text handled at once, about.
TEXT_BYTES = 4 << 20


@dataclass(frozen=True)
class WordModel:
    """``costs``: micro-nats of each word, syllables joined by ``_``; ``unknown``: those of any other syllable."""

    costs: dict[str, int]
    unknown: int
    longest: int

    @cached_property
    def beginnings(self) -> set[str]:
        """What a word of several syllables may begin with. Made where it is used, not shipped."""
        return {w[:k] for w in self.costs for k, c in enumerate(w) if c == "_"}

    @classmethod
    def of_counts(cls, counts: dict[str, float], longest: int) -> WordModel:
        total = sum(counts.values()) or 1.0
        costs = {w: round(-math.log(n / total) * MICRO) for w, n in counts.items() if n > 0}
        return cls(costs, round(-math.log(0.5 / max(total, 1.0)) * MICRO), longest)


def _ways(syllables: list[str], model: WordModel) -> list[list[tuple[int, str, int]]]:
    """(start, word, cost) of the words that may end after each syllable, the longest first."""
    costs, beginnings, n = model.costs, model.beginnings, len(syllables)
    ways: list[list[tuple[int, str, int]]] = [[] for _ in range(n)]
    for start, word in enumerate(syllables):
        ways[start].append((start, word, costs.get(word, model.unknown)))
        for end in range(start + 1, min(n, start + model.longest)):
            if word not in beginnings:
                break
            word = f"{word}_{syllables[end]}"
            cost = costs.get(word)
            if cost is not None:
                ways[end].append((start, word, cost))
    return ways


def segment(syllables: list[str], model: WordModel) -> list[str]:
    """The cheapest division of one text."""
    best: list[tuple[int, int]] = [(0, 0)]
    back: list[tuple[int, str]] = [(0, "")]
    for ways in _ways(syllables, model):
        now = None
        for start, word, cost in ways:
            found = (best[start][0] + cost, best[start][1] + 1)
            if now is None or found < now:
                now, way = found, (start, word)
        best.append(now)
        back.append(way)
    words, end = [], len(syllables)
    while end:
        start, word = back[end]
        words.append(word)
        end = start
    return words[::-1]


def expected_counts(syllables: list[str], model: WordModel, into: dict[str, float]) -> None:
    """Adds the expected number of each word over all divisions of one text. Sums are scaled at each place, so
    that long texts don't vanish."""
    n = len(syllables)
    scale, backward = [1.0] * (n + 1), [0.0] * n + [1.0]
    steps: list[list[tuple[int, str, float]]] = []
    for end, ways in enumerate(_ways(syllables, model), 1):
        found = []
        for start, word, cost in ways:
            p = math.exp(-cost / MICRO)
            for k in range(start + 1, end):
                p /= scale[k]
            found.append((start, word, p))
        total = scale[end] = sum(p for _, _, p in found)
        steps.append([(start, word, p / total) for start, word, p in found])
    for end in range(n, 0, -1):
        for start, _, p in steps[end - 1]:
            backward[start] += p * backward[end]
    for end in range(1, n + 1):
        for start, word, p in steps[end - 1]:
            into[word] = into.get(word, 0.0) + p * backward[end]


def _counted(shared):
    """Sums of the words of the model; syllables it doesn't know stay in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, numbered, chances, listed = shared.value
        sums = np.zeros(len(listed), np.int64)
        for chunk in chunks(batches, "numbers", NUMBER_BYTES):
            plain = chunk.filter(pc.is_null(chunk["odd"]))
            sums += expected(numbers_of(plain["numbers"]), numbered, chances, len(listed), MICRO)
            for line in chunk["odd"].drop_null().to_pylist():
                mine: dict[str, float] = {}
                expected_counts(line.split(" "), model, mine)
                for word, x in mine.items():
                    if word in listed:
                        sums[listed[word]] += round(x * MICRO)
        held = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(sums[held])], names=["place", "n"])

    return run


def _written(words: pa.Array, rows: np.ndarray, texts: int, joined: np.ndarray) -> pa.Array:
    """The words of each text, ``_`` behind the joined ones, a blank behind the others, none behind the last."""
    last = np.ones(len(rows), bool)
    last[:-1] = rows[1:] != rows[:-1]
    ends = np.where(last, 2, np.where(joined, 1, 0))
    behind = pa.DictionaryArray.from_arrays(pa.array(ends, pa.int8()), pa.array([" ", "_", ""])).cast(pa.string())
    starts = pa.array(np.searchsorted(rows, np.arange(texts + 1)), pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(starts, pc.binary_join_element_wise(words, behind, "")), "")


def _divided(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, numbered, vocabulary = shared.value
        for chunk in chunks(batches, "text", TEXT_BYTES):
            words, rows = split_words(chunk["text"])
            numbers, odd = numbered_words(words, rows, len(chunk), vocabulary)
            texts = _written(words, rows, len(chunk), glued(numbers, numbered)[numbers != END])
            if odd.any():
                starts = np.searchsorted(rows, np.arange(len(chunk) + 1))
                lists = [words[starts[k] : starts[k + 1]].to_pylist() for k in np.flatnonzero(odd)]
                mine = pa.array([" ".join(segment(w, model)) for w in lists], pa.string())
                texts = pc.replace_with_mask(texts, pa.array(odd), mine)
            yield pa.RecordBatch.from_arrays([chunk["key"].combine_chunks(), texts], names=["key", "text"])

    return run


def _chances(model: NumberedModel) -> list[np.ndarray]:
    """e to the minus cost of the words of each size."""
    costs = [model.costs, *[c for _, c, _ in model.levels]]
    return [np.array([math.exp(-c / MICRO) for c in x.tolist()], np.float64) for x in costs]


def cohesive(counts: dict[str, int], sizes: dict[str, int], ratio: int = RATIO) -> set[str]:
    """Single syllables, and the runs that hold together at every cut."""
    total = sum(n for w, n in counts.items() if sizes[w] == 1)
    kept = set()
    for word, n in counts.items():
        parts = word.split("_") if sizes[word] > 1 else []
        cuts = (("_".join(parts[:k]), "_".join(parts[k:])) for k in range(1, len(parts)))
        if all(a in counts and b in counts and n * total > ratio * counts[a] * counts[b] for a, b in cuts):
            kept.add(word)
    return kept


def fit_words(
    docs: DataFrame, text: str, longest: int = LONGEST, least: int = LEAST, rounds: int = ROUNDS, most: int = MOST
) -> WordModel:
    """The word model of all texts. Null and empty texts have no syllables; repeated rows count each time."""
    spark = docs.sparkSession
    found, texts, vocabulary = frequent_runs(docs, text, longest, least, most)  # at most ``most`` rows
    words, numbers = found["word"].to_pylist(), found["n"].to_pylist()
    sizes, first = dict(zip(words, found["size"].to_pylist())), dict(zip(words, numbers))
    model = WordModel.of_counts({w: float(first[w]) for w in cohesive(first, sizes)}, longest)
    names = list(sizes)
    listed = {w: k for k, w in enumerate(names)}
    for _ in range(rounds):
        numbered = NumberedModel.of(model, vocabulary, listed)
        shared = spark.sparkContext.broadcast((model, numbered, _chances(numbered), listed))
        sums = texts.mapInArrow(_counted(shared), "place int, n long").groupBy("place").agg(F.sum("n").alias("n"))
        table = sums.toArrow().sort_by("place")  # at most ``most`` rows
        counts = {names[k]: n / MICRO for k, n in zip(table["place"].to_pylist(), table["n"].to_pylist())}
        model = WordModel.of_counts({w: n for w, n in counts.items() if n >= least or sizes[w] == 1}, longest)
        shared.unpersist()
    return model


def segment_texts(docs: DataFrame, model: WordModel, key: str, text: str) -> DataFrame:
    """``key`` and ``text`` with the syllables of a word joined by ``_``, words by one blank; one row a row of
    ``docs``. Null and empty texts give empty ones."""
    vocabulary = simple_parts(list(model.costs))
    numbered = NumberedModel.of(model, vocabulary, {})
    shared = docs.sparkSession.sparkContext.broadcast((model, numbered, pa.array(vocabulary, pa.string())))
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    done = rows.mapInArrow(_divided(shared), f"key {kind}, text string")
    return done.select(F.col("key").alias(key), F.col("text").alias(text))
