"""Phrases whose words occur together more often than apart, mined the way Toivonen does.

1. A sample of the documents proposes words and pairs: those seen SAMPLE_LEAST times in it.
2. One pass over all documents counts exactly what was proposed and its negative border: all words, pairs of
   proposed words, triples whose two pairs are proposed.
3. What the border shows to be frequent, but was not proposed, may have longer phrases nobody counted: border
   failures. It joins the proposals, and another pass counts what they let in and no pass before did. This is
   repeated until a pass finds no border failure; then no frequent phrase is uncounted, whatever the sample was.

Whether a phrase is let in is looked up in a bit map of fixed size, made by a grouped aggregation: a false bit lets in
a phrase too many, which is counted exactly like the others, never one too few. Counting works on blocks of
bytes: words are found and hashed as arrays, equal phrases of a block become one row, rows meet by text.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, left_join_by_key, whole_text
from .word_hash import bounds, mix, word_hashes

LEAST = 10
TOP = 2_000
#: A phrase goes if a longer one around it has this share of its occurrences, in percent.
INSIDE = 50
#: One document in so many is sampled.
SAMPLE = 16
SAMPLE_LEAST = 2
#: Bits of a bit map (a power of two); a documented bound on what is broadcast, 8 MB a map.
BITS = 26
#: Bytes of text counted at once.
BLOCK = 1 << 20
#: Bytes that wait in all languages' blocks together.
WAITING = 1 << 22
UNKNOWN = "und"
MAX_PASSES = 20

SPACES = " \t"
BREAKS = ".,;:!?\n\v\f\r"
_FOLD = bytes.maketrans(
    (string.ascii_uppercase + SPACES + BREAKS).encode(),
    (string.ascii_lowercase + " " * len(SPACES) + "\n" * len(BREAKS)).encode(),
)


def _seed(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass")) >> 1


def _pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + b)


def _inside(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
    return (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def _slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All ``data[start:end]`` after one another."""
    size = ends - starts
    shift = np.repeat(starts - (np.cumsum(size) - size), size)
    return data[shift + np.arange(len(shift))]


class _Block:
    """Counts of one block of folded bytes of one language; ``skip`` leading words were counted before."""

    def __init__(self, raw: bytes, lang: str, skip: int):
        data = np.frombuffer(raw, np.uint8)
        starts, ends = bounds((data != 32) & (data != 10))
        line = np.cumsum(data == 10)[starts] if len(starts) else np.zeros(0, np.int64)
        self.skip, self.breaks_after = skip, b"\n" in (raw[ends[-1] :] if len(ends) else raw)
        self.near = line[1:] == line[:-1]
        # The words with one blank after each: every phrase is a slice.
        self.data = _slices(np.append(data, np.uint8(32)), starts, ends + 1)
        self.data[np.cumsum(ends - starts + 1) - 1] = 32
        self.ends = np.cumsum(ends - starts + 1) - 1
        self.starts = self.ends - (ends - starts)
        self.hashes = word_hashes(self.data, self.starts, self.ends, _seed(lang))
        _, self.first, self.ids = np.unique(self.hashes, return_index=True, return_inverse=True)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def _phrases(self, at: np.ndarray, size: int) -> pa.Array:
        starts, ends = self.starts[at], self.ends[at + size - 1]
        offsets = np.concatenate((np.zeros(1, np.int64), np.cumsum(ends - starts)))
        body = _slices(self.data, starts, ends)
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(body)).cast(pa.string())

    def words(self):
        counts = np.bincount(self.ids[self.skip :], minlength=len(self.first))
        seen = np.flatnonzero(counts)
        return self._phrases(self.first[seen], 1), counts[seen]

    def _grams(self, codes: np.ndarray, at: np.ndarray, size: int):
        """Distinct codes of the phrases that begin at words ``at``, as (texts, counts)."""
        _, first, counts = np.unique(codes, return_index=True, return_counts=True)
        return self._phrases(at[first], size), counts

    def pairs(self, let_in: np.ndarray):
        at = np.flatnonzero(self.near & let_in)
        at = at[at + 1 >= self.skip]
        return self._grams((self.ids[at] << 32) | self.ids[at + 1], at, 2)

    def triples(self, let_in: np.ndarray):
        at = np.flatnonzero(self.near[:-1] & self.near[1:] & let_in)
        at = at[at + 2 >= self.skip]
        _, pair = np.unique((self.ids[at] << 32) | self.ids[at + 1], return_inverse=True)
        return self._grams((pair << 32) | self.ids[at + 2], at, 3)

    def pair_hashes(self) -> np.ndarray:
        return _pair_hash(self.hashes[:-1], self.hashes[1:])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, _Block]]:
    """Folded texts gathered by language. A text longer than a block is cut at blanks, with the two words before
    the cut repeated, so that no phrase is lost and none counted twice."""
    waiting: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            raw = text.as_py().encode("utf-8", "surrogatepass").translate(_FOLD)
            if len(raw) > BLOCK:
                yield from _cut(lang, raw)
                continue
            waiting.setdefault(lang, []).append(raw)
            sizes[lang] = sizes.get(lang, 0) + len(raw) + 1
            if sizes[lang] >= BLOCK:
                yield lang, _Block(b"\n".join(waiting.pop(lang)), lang, 0)
                sizes.pop(lang)
            elif sum(sizes.values()) >= WAITING:
                for k, texts in waiting.items():
                    yield k, _Block(b"\n".join(texts), k, 0)
                waiting, sizes = {}, {}
    for k, texts in waiting.items():
        yield k, _Block(b"\n".join(texts), k, 0)


def _cut(lang: str, raw: bytes) -> Iterator[tuple[str, _Block]]:
    at, head = 0, b""
    while at < len(raw):
        end = min(len(raw), at + BLOCK)
        while end < len(raw) and raw[end] not in b" \n":  # a word that goes on is whole
            end += 1
        block = _Block(head + raw[at:end], lang, len(head.split()))
        yield lang, block
        tail = [block.word(i) for i in range(max(0, len(block.starts) - 2), len(block.starts))]
        glue = b" " if len(tail) < 2 or block.near[-1] else b"\n"
        head = glue.join(tail) + (b"\n" if block.breaks_after else b" ")
        at = end


def _rows(lang: str, found) -> pa.RecordBatch:
    texts, counts = found
    langs = pa.DictionaryArray.from_arrays(np.zeros(len(texts), np.int32), [lang]).cast(pa.string())
    return pa.RecordBatch.from_arrays([langs, texts, pa.array(np.asarray(counts, np.int64))], names=["lang", "phrase", "n"])


_COUNTS = "lang string, phrase string, n long"


def _size() -> Column:
    """Words of a phrase; the empty one, which stands for all words, has none."""
    blanks = F.length("phrase") - F.length(F.replace("phrase", F.lit(" "), F.lit("")))
    return F.when(F.col("phrase") == "", 0).otherwise(blanks + 1)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for lang, block in _blocks(batches):
        yield _rows(lang, block.words())
        if len(block.near):
            yield _rows(lang, block.pairs(np.ones(len(block.near), bool)))


def _new(now: np.ndarray, before: np.ndarray | None, hashes: np.ndarray) -> np.ndarray:
    """Neighbours that are both let in now and weren't both before."""
    let_in = _inside(now, hashes)
    both = let_in[:-1] & let_in[1:]
    if before is not None:
        old = _inside(before, hashes)
        both &= ~(old[:-1] & old[1:])
    return both


def _counted(maps, first: bool):
    """One pass. ``maps``: bit maps of words and of pairs, now and in the pass before (None: there was none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs, old_words, old_pairs = maps.value
        for lang, block in _blocks(batches):
            if first:
                found = block.words()
                yield _rows(lang, found)
                yield _rows(lang, (pa.array([""]), [int(found[1].sum())]))
            if len(block.near):
                yield _rows(lang, block.pairs(_new(words, old_words, block.hashes)))
            if len(block.near) > 1:
                yield _rows(lang, block.triples(_new(pairs, old_pairs, block.pair_hashes())))

    return run


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phrases of one or two words to their place in the bit map of their size."""
    for batch in batches:
        out = np.zeros(len(batch), np.uint64)
        langs = batch.column("lang").dictionary_encode()
        for code, lang in enumerate(langs.dictionary.to_pylist()):
            mine = np.flatnonzero(langs.indices.to_numpy() == code)
            texts, two = batch.column("phrase").take(pa.array(mine)), batch.column("size").to_numpy()[mine] == 2
            data = np.frombuffer("\n".join(texts.to_pylist()).encode("utf-8", "surrogatepass"), np.uint8)
            h = word_hashes(data, *bounds((data != 32) & (data != 10)), _seed(lang))
            first = np.cumsum(two + 1) - two - 1  # of its words
            out[mine] = h[first]
            out[mine[two]] = _pair_hash(h[first[two]], h[first[two] + 1])
        place = (out >> np.uint64(64 - BITS)).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("size"), pa.array((place >> 5).astype(np.int32)), pa.array(np.left_shift(1, place & 31))],
            names=["size", "slot", "bit"],
        )


def _bit_maps(phrases: DataFrame) -> dict[int, np.ndarray]:
    """A bit map for words and one for pairs; the driver gets at most 2**BITS bits for each."""
    slots = phrases.filter("size <= 2").select("lang", "size", "phrase").mapInArrow(_places, "size int, slot int, bit long")
    found = slots.groupBy("size", "slot").agg(F.bit_or("bit").alias("bits")).toArrow()
    size, slot, bits = (found.column(c).to_numpy() for c in ("size", "slot", "bits"))
    maps = {}
    for k in (1, 2):
        table = np.zeros(1 << (BITS - 5), "<u4")
        table[slot[size == k]] = bits[size == k].astype(np.uint32)
        maps[k] = table.view(np.uint8)
    return maps


def frequent_phrases(docs: DataFrame, least: int = LEAST, sample: int = SAMPLE) -> DataFrame:
    """``docs(lang, text)``, no nulls, to (lang, size, phrase, n): all phrases of up to three words with at least
    ``least`` occurrences, exactly counted; with size 0 the number of words of a language."""
    spark = docs.sparkSession
    some = docs.filter(F.pmod(F.xxhash64("lang", "text"), F.lit(sample)) == 0)
    seen = some.mapInArrow(_sampled, _COUNTS).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    seen = seen.withColumn("size", _size())
    now = _bit_maps(seen.filter(F.col("n") >= min(SAMPLE_LEAST, least)))
    before = dict.fromkeys(now)
    found = None
    for pass_ in range(MAX_PASSES):
        maps = spark.sparkContext.broadcast((now[1], now[2], before[1], before[2]))
        counted = docs.mapInArrow(_counted(maps, pass_ == 0), _COUNTS).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
        counted = counted.filter((F.col("n") >= least) | (F.col("phrase") == ""))
        counted = keep(counted.withColumn("size", _size()), "mining-pass")
        maps.destroy()
        found = counted if found is None else found.unionByName(counted)
        more = _bit_maps(counted.filter("size > 0"))
        before, now = now, {k: now[k] | more[k] for k in now}
        if all((now[k] == before[k]).all() for k in now):
            return found
    raise RuntimeError(f"phrases did not close in {MAX_PASSES} passes")


def collocations(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, top: int = TOP, sample: int = SAMPLE
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best ``top`` phrases of two or three words of each language.

    Texts are lower-cased (A-Z) and split at ``.,;:!?`` and line ends into pieces, those at blanks and tabs into
    words. a: occurrences of the phrase, at least ``least``; l, r: those of its two parts at the cut with the
    lowest score, the first such cut; n: words of the language; score: floor(1000000 * a * a / (l * r)), in
    decimals. Phrases go that lie in a longer one with at least INSIDE % of their occurrences. Ties go to the
    larger a, then to the first phrase in UTF-8. Rows without a language are of language ``und``; null and
    empty texts have no words. Repeated rows count each time. An empty table gives an empty result. Other columns are ignored.
    """
    rows = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), whole_text(text_col).alias("text")
    ).filter("text <> ''")
    found = keep(frequent_phrases(rows, least, sample), "mining-frequent")
    key = F.struct("lang", "phrase")
    parts = found.filter("size > 0").select(key.alias("part"), F.col("n").alias("f"))
    words = F.split("phrase", " ")
    cuts = found.filter("size > 1").select(
        "lang", "phrase", "size", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    )
    cuts = cuts.select(
        "lang", "phrase", "size", "a", "k",
        F.struct("lang", F.array_join(F.slice(words, F.lit(1), F.col("k")), " ").alias("phrase")).alias("left"),
        F.struct("lang", F.array_join(F.slice(words, F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("phrase")).alias("right"),
    )
    cuts = keep(cuts, "mining-cuts")
    for side, name in (("left", "l"), ("right", "r")):
        used = cuts.groupBy(F.col(side).alias("part")).agg(F.count(F.lit(1)).alias("used"))
        counted = keep(parts.join(used, "part").select(F.col("part").alias(side), F.col("f").alias(name), "used"), "mining-parts")
        cuts = keep(left_join_by_key(cuts, counted, side, "used").drop("used", side), "mining-cuts")
    wide = {c: f"CAST({c} AS DECIMAL(18,0))" for c in "lr"} | {"a": "CAST(a AS DECIMAL(16,0))"}
    score = F.expr(f"(1000000BD * {wide['a']} * {wide['a']}) div ({wide['l']} * {wide['r']})")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    best = best.select("lang", "phrase", "size", "a", "cut.l", "cut.r", "cut.score")
    inner = F.array(F.slice(words, 1, 2), F.slice(words, 2, 2))
    longer = found.filter("size = 3").select("lang", "n", F.explode(F.transform(inner, lambda w: F.array_join(w, " "))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("n").alias("around"))
    alone = best.join(longer, ["lang", "phrase"], "left")
    alone = alone.filter((F.col("size") == 3) | F.col("around").isNull() | (100 * F.col("around") < INSIDE * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = alone.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    totals = found.filter("size = 0").select("lang", F.col("n").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
