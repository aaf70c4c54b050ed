"""Runs of neighbouring words that occur most often in a corpus, and how often, without a row a run.

A row a run, grouped in the map tasks, ships nearly every run of the corpus: most occur once or twice. Here texts become
lists of word numbers once, and runs are counted one size after the other:

* No run is more frequent than a run inside it, and of equally frequent ones the shorter goes first. So only runs whose two
  halves (all but the last word, all but the first) are among the ``most`` so far can be, and only if they occur more often
  than the last of these.
* Runs are first counted by the hash of their numbers, in a table of fixed size a task. Those whose slot has fewer counts
  than a run needs are out; counts of slots are never too low, so no run is lost. The others are counted exactly.

What is shipped is a table of slots a task and the runs left, each task's added up before. A task's memory depends on neither
its texts nor the number of runs; where there are more runs left than it may hold, it ships them in several lots.

Runs of words joined by ``_`` are told apart by their words unless these have ``_`` in them; such runs are few and are
counted as strings.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .counts import ALL, chunks, count_terms, split_words
from .numbering import number_rows

#: Bytes of numbered text handled at once, about; a text is never divided.
NUMBER_BYTES = 2 << 20
#: Runs a task holds before it ships them.
HELD = 1 << 20
#: Slots of a task's table, as a power of two.
LEAST_BITS, MOST_BITS = 12, 23
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Between the texts, and a word without a number.
END, UNKNOWN = -1, 0
ORDER = [("n", "descending"), ("size", "ascending"), ("word", "ascending")]


def mixed(codes: np.ndarray, bits: int) -> np.ndarray:
    return ((codes.astype(np.uint64) * MIX) >> np.uint64(64 - bits)).astype(np.int64)


@dataclass(frozen=True)
class Codes:
    """Sorted distinct numbers, and where a number is among them."""

    held: np.ndarray

    @cached_property
    def bits(self) -> int:
        return max(4, int(len(self.held)).bit_length() + 4)

    @cached_property
    def slots(self) -> np.ndarray:
        """True where one of them may be. Made where it is used, not shipped."""
        found = np.zeros(1 << self.bits, bool)
        found[mixed(self.held, self.bits)] = True
        return found

    def places(self, wanted: np.ndarray) -> np.ndarray:
        """-1 for numbers that are not held."""
        out = np.full(len(wanted), -1, np.int32)
        if len(self.held):
            may = np.flatnonzero(self.slots[mixed(wanted, self.bits)])
            at = np.minimum(np.searchsorted(self.held, wanted[may]), len(self.held) - 1)
            same = self.held[at] == wanted[may]
            out[may[same]] = at[same]
        return out


# --- texts as numbers ----------------------------------------------------------------


def simple_parts(words: list[str]) -> list[str]:
    """The words without ``_``, then what stands between the ``_`` of the others, each once."""
    simple = dict.fromkeys(w for w in words if "_" not in w)
    return list(simple | dict.fromkeys(p for w in words if "_" in w for p in w.split("_") if p))


def numbered_words(words: pa.Array, rows: np.ndarray, texts: int, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 1 of the words of all texts in ``vocabulary``, END behind each text; which texts have a word with ``_``."""
    coded = words.dictionary_encode()
    codes, known = coded.indices.to_numpy(), coded.dictionary
    numbers = pc.fill_null(pc.index_in(known, value_set=vocabulary), -1).to_numpy().astype(np.int32) + 1
    out = np.full(len(codes) + texts, END, np.int32)
    out[np.arange(len(codes)) + rows] = numbers[codes]
    odd = np.zeros(texts, bool)
    joint = pc.match_substring(known, "_").to_numpy(zero_copy_only=False)
    if joint.any():
        odd[rows[joint[codes]]] = True
    return out, odd


def _numbered(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for chunk in chunks(batches, "text"):
            words, rows = split_words(chunk["text"])
            numbers, odd = numbered_words(words, rows, len(chunk), vocabulary)
            ends = np.flatnonzero(numbers == END) + 1
            offsets = np.concatenate(([0], ends)).astype(np.int64) * numbers.itemsize
            texts = pa.Array.from_buffers(
                pa.large_binary(), len(chunk), [None, pa.py_buffer(offsets), pa.py_buffer(numbers)]
            ).cast(pa.binary())
            lines = pa.nulls(len(chunk), pa.string())
            if odd.any():
                starts = np.searchsorted(rows, np.arange(len(chunk) + 1))
                split = [words[starts[k] : starts[k + 1]].to_pylist() for k in np.flatnonzero(odd)]
                lines = pc.replace_with_mask(lines, pa.array(odd), pa.array([" ".join(w) for w in split], pa.string()))
            yield pa.RecordBatch.from_arrays([texts, lines], names=["numbers", "odd"])

    return run


def numbers_of(texts: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The numbers of all texts one after the other, END behind each."""
    held = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    if not len(held):
        return np.zeros(0, np.int32)
    offsets = np.frombuffer(held.buffers()[1], np.int32)[held.offset : held.offset + len(held) + 1]
    return np.frombuffer(held.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(np.int32)


# --- runs of one size ----------------------------------------------------------------


def run_codes(numbers: np.ndarray, base: int, levels: list[Codes]) -> np.ndarray:
    """Of every run of two words more than ``levels`` whose halves are held: where its first half is, and its last word."""
    state = np.where(numbers > UNKNOWN, numbers, -1)
    for size in range(1, len(levels) + 2):
        at = np.flatnonzero((state[:-1] >= 0) & (state[1:] >= 0))
        codes = state[at].astype(np.int64) * base + numbers[at + size]
        if size <= len(levels):
            state = np.full(len(numbers), -1, np.int32)
            state[at] = levels[size - 1].places(codes)
    return codes


def _slots_of(bits: int, parts: int) -> list[tuple[int, int]]:
    edges = [(k << bits) // parts for k in range(parts + 1)]
    return list(zip(edges, edges[1:]))


def _sketched(shared, bits: int, need: int, parts: int):
    """A task's counts by slot; more than ``need`` in one tells no more than ``need``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, levels = shared.value
        sums = np.zeros(1 << bits, np.int32)
        for chunk in chunks(batches, "numbers", NUMBER_BYTES):
            np.add.at(sums, mixed(run_codes(numbers_of(chunk["numbers"]), base, levels), bits), np.int32(1))
        kept = np.minimum(sums, need).astype(np.min_scalar_type(need))
        blobs = [pa.compress(kept[i:j].tobytes(), "zstd", asbytes=True) for i, j in _slots_of(bits, parts)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(parts), pa.int32()), pa.array(blobs, pa.binary())], names=["part", "counts"]
        )

    return run


def _often(bits: int, need: int, parts: int):
    def run(part: pa.Table) -> pa.Table:
        number = part["part"][0].as_py()
        i, j = _slots_of(bits, parts)[number]
        kind = np.min_scalar_type(need)
        sums = np.zeros(j - i, np.int64)
        for blob in part["counts"]:
            sums += np.frombuffer(pa.decompress(blob.as_py(), (j - i) * kind.itemsize, "zstd", asbytes=True), kind)
        packed = np.packbits(sums >= need).tobytes()
        return pa.table({"part": pa.array([number], pa.int32()), "often": pa.array([packed], pa.binary())})

    return run


def _added(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, sorted, and their sums."""
    found, places = np.unique(np.concatenate(codes), return_inverse=True)
    return found, np.bincount(places, np.concatenate(counts), len(found)).astype(np.int64)


def _parcels(codes: np.ndarray, counts: np.ndarray, parts: int) -> pa.RecordBatch:
    """One row a part of the codes by hash: the steps between its sorted codes, and its counts."""
    part = mixed(codes, 32) % parts
    order = np.argsort(part, kind="stable")
    numbers, starts = np.unique(part[order], return_index=True)
    edges = list(zip(starts, [*starts[1:], len(order)]))
    steps = [np.diff(codes[order[i:j]], prepend=0).tobytes() for i, j in edges]
    sums = [counts[order[i:j]].tobytes() for i, j in edges]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(numbers, pa.int32()), pa.array([j - i for i, j in edges], pa.int64()),
            *[pa.array([pa.compress(x, "zstd", asbytes=True) for x in xs], pa.binary()) for xs in (steps, sums)],
        ],
        names=["part", "size", "codes", "counts"],
    )


def _counted(shared, bits: int, parts: int):
    """Exact counts of the runs in slots that have enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, levels, packed = shared.value
        often = np.unpackbits(np.frombuffer(packed, np.uint8)).view(bool)
        codes: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        for chunk in chunks(batches, "numbers", NUMBER_BYTES):
            found = run_codes(numbers_of(chunk["numbers"]), base, levels)
            mine, n = np.unique(found[often[mixed(found, bits)]], return_counts=True)
            codes.append(mine)
            counts.append(n)
            if sum(map(len, codes)) > HELD:
                one, n = _added(codes, counts)
                codes, counts = [one], [n]
                if len(one) > HELD // 2:
                    yield _parcels(one, n, parts)
                    codes, counts = [], []
        if codes:
            yield _parcels(*_added(codes, counts), parts)

    return run


def _enough(shared, need: int):
    def run(part: pa.Table) -> pa.Table:
        base, halves, names = shared.value
        codes, counts = [], []
        for row in part.to_pylist():
            steps, sums = (
                np.frombuffer(pa.decompress(row[x], row["size"] * 8, "zstd", asbytes=True), np.int64)
                for x in ("codes", "counts")
            )
            codes.append(np.cumsum(steps))
            counts.append(sums)
        found, n = _added(codes, counts)
        found, n = found[n >= need], n[n >= need]
        half, last = np.divmod(found, base)
        words = pc.binary_join_element_wise(halves.take(pa.array(half)), names.take(pa.array(last)), "_")
        return pa.table({"word": words, "code": found, "n": n})

    return run


# --- the most frequent ---------------------------------------------------------------


def _most_frequent(rows: DataFrame, most: int) -> pa.Table:
    """At most ``most`` rows of ``rows`` (word, n, ...), a stored table: the most frequent, of equally frequent ones by word. The
    driver gets these, and a row for every different n."""
    levels = rows.groupBy("n").agg(F.count(F.lit(1)).alias("rows")).toArrow().sort_by([("n", "descending")])
    reached = np.cumsum(levels["rows"].to_numpy())
    if not len(reached) or reached[-1] <= most:
        return rows.toArrow()
    last = levels["n"][int(np.searchsorted(reached, most))].as_py()
    placed = number_rows(rows.filter(F.col("n") >= last), [F.desc("n"), F.asc("word")], "place")
    return placed.filter(F.col("place") <= most).drop("place").toArrow()


def _sized(rows: pa.Table, size: int) -> pa.Table:
    codes = rows["code"] if "code" in rows.column_names else pa.array(np.zeros(len(rows), np.int64))
    table = pa.table({"word": rows["word"], "size": pa.array(np.full(len(rows), size, np.int32)), "n": rows["n"], "code": codes})
    return table.cast(pa.schema([("word", pa.string()), ("size", pa.int32()), ("n", pa.int64()), ("code", pa.int64())]))


def _first(tables: list[pa.Table], most: int) -> pa.Table:
    return pa.concat_tables(tables).sort_by(ORDER).slice(0, most)


def _of_size(texts: DataFrame, base: int, levels: list[Codes], halves: pa.Array, names: pa.Array, need: int, words: int) -> DataFrame:
    """word, code, n of the runs one word longer than ``halves`` that occur ``need`` times or more."""
    spark = texts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = min(MOST_BITS, max(LEAST_BITS, int(16 * words // need).bit_length()))
    numbers = texts.select("numbers")
    shared = spark.sparkContext.broadcast((base, levels))
    slots = numbers.mapInArrow(_sketched(shared, bits, need, parts), "part int, counts binary")
    found = slots.groupBy("part").applyInArrow(_often(bits, need, parts), "part int, often binary").toArrow()
    often = np.zeros(1 << bits, bool)
    for part, packed in zip(found["part"].to_pylist(), found["often"].to_pylist()):
        i, j = _slots_of(bits, parts)[part]
        often[i:j] = np.unpackbits(np.frombuffer(packed, np.uint8), count=j - i)
    shared = spark.sparkContext.broadcast((base, levels, np.packbits(often).tobytes()))
    counted = numbers.mapInArrow(_counted(shared, bits, parts), "part int, size long, codes binary, counts binary")
    named = spark.sparkContext.broadcast((base, halves, names))
    return counted.groupBy("part").applyInArrow(_enough(named, need), "word string, code long, n long")


def _joint_runs(n: int) -> Column:
    """(word, size) of every run of ``n`` words of the array ``w`` with ``_`` inside a word."""
    starts = F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - (n - 1))).otherwise(F.array().cast("array<int>"))

    def run(start: Column) -> Column:
        return F.struct(F.array_join(F.slice("w", start, F.lit(n)), "_").alias("word"), F.lit(n).alias("size"))

    return F.filter(F.transform(starts, run), lambda r: F.length(r["word"]) - F.length(F.replace(r["word"], F.lit("_"))) >= n)


def _joint(texts: DataFrame, longest: int, least: int, most: int) -> list[pa.Table]:
    odd = texts.filter("odd is not null")
    if longest < 2 or odd.isEmpty():
        return []
    rows = odd.select(F.split("odd", " ").alias("w"))
    runs = F.flatten(F.array(*[_joint_runs(n) for n in range(2, longest + 1)]))
    seen = stored(
        rows.select(F.inline(runs)).groupBy("word", "size").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least), "joint"
    )
    return [_sized(_most_frequent(seen.filter(F.col("size") == n).drop("size"), most), n) for n in range(2, longest + 1)]


def frequent_runs(docs: DataFrame, text: str, longest: int, least: int, most: int) -> tuple[pa.Table, DataFrame, list[str]]:
    """The ``most`` frequent words and runs of up to ``longest`` words that occur ``least`` times, of equally frequent ones
    first the shorter, then by ``word`` (word, size, n; its words joined by ``_``); all texts as numbers (``numbers``, and the
    words of texts that have ``_`` in one as ``odd``); the words that have the numbers from 1."""
    spark = docs.sparkSession
    counted = stored(count_terms(docs, text), "words", compression="zstd")
    total = counted.filter(F.col("term") == ALL).agg(F.sum("n")).first()[0] or 0
    singles = counted.filter(F.col("term") != ALL).select(F.col("term").alias("word"), "n")
    found = _first([_sized(_most_frequent(singles, most), 1)], most)
    vocabulary = simple_parts(found["word"].to_pylist())
    names = pa.array(vocabulary, pa.string())
    shared = spark.sparkContext.broadcast(names)
    texts = stored(
        docs.select(F.col(text).alias("text")).mapInArrow(_numbered(shared), "numbers binary, odd string"), "numbered_texts",
        compression="zstd",
    )
    base, names = len(vocabulary) + 1, pa.concat_arrays([pa.array([""], pa.string()), names])
    levels: list[Codes] = []
    halves = names
    for size in range(2, longest + 1):
        need = max(1, least, found["n"][-1].as_py() + 1 if len(found) >= most and len(found) else 0)
        mine = stored(_of_size(texts, base, levels, halves, names, need, total), "runs", compression="zstd")
        found = _first([found, _sized(_most_frequent(mine, most), size)], most)
        held = found.filter(pc.equal(found["size"], size)).sort_by("code")
        if not len(held):
            break
        levels.append(Codes(held["code"].to_numpy()))
        halves = held["word"].combine_chunks()
    found = _first([found, *_joint(texts, longest, least, most)], most)
    return found.drop_columns(["code"]), texts, vocabulary
