"""Words of passages that occur earlier in the corpus, found with prefix-partitioned suffix trees.

A suffix is a place in a document's sequence of words; what counts is how far two suffixes agree, up to WINDOW words.

1. Equal word sequences of whole documents are combined first: every window of a copy also starts earlier.
2. Which suffixes can share WINDOW words? Of the prefixes of GRAM words in a window the one with the smallest hash
   is its anchor; equal windows have equal anchors. Anchors are compared over the whole corpus (copies within a
   task first, then one row a task and anchor); windows of an anchor that occurs once hang on a leaf of their
   own and are done. About one anchor in seven words travels, 20 bytes.
3. The other suffixes are dealt to subtrees by prefixes of variable length: range partitioning cuts the order of
   (first five words, next five, all twenty) where the groups become equal in size, deep inside a frequent
   prefix and between rare ones. A task holds one subtree as its sorted leaves; the nodes at the depth of
   WINDOW words are the runs of leaves that agree that far. Equal suffixes of a task are one leaf.
4. The earliest leaf of such a node is sent back to its document. Every other window with an anchor that
   repeats is removed: it is a repeat of that leaf.

Words are compared by 64-bit hashes of five, ten and twenty words together (128 bits a suffix).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keep, left_join_by_key, whole_text
from .ranges import running, task_count
from .word_hash import bounds, mix, word_hashes

WINDOW, GRAM, STEP = 20, 8, 5
SPAN = WINDOW - GRAM + 1
#: Bytes of text whose suffixes are hashed at once.
BLOCK = 1 << 20
#: Anchors or suffixes that a task compares at once.
HELD = 1 << 19
#: Bits of the map of wanted documents (a bound on what is broadcast: 8 MB).
BITS = 26


def _joined(text: str | None) -> bytes:
    return b" ".join((text or "").encode("utf-8", "surrogatepass").split())


def _chunks(joined: bytes) -> Iterator[tuple[bytes, int]]:
    """(bytes, number of their first word): long texts in chunks; each window lies in exactly one from its start."""
    at, word = 0, 0
    while True:
        end = joined.find(b" ", at + BLOCK) if len(joined) - at > BLOCK else -1
        count = joined.count(b" ", at, end) + 1 if end >= 0 else 0
        while end >= 0 and count < 2 * WINDOW:  # very long words: a chunk holds some windows at least
            end, count = joined.find(b" ", end + 1), count + 1
        if end < 0:
            yield joined[at:], word
            return
        yield joined[at:end], word
        back = end
        for _ in range(WINDOW - 1):  # the last words may begin windows that the chunk doesn't hold
            back = joined.rfind(b" ", at, back)
        word += count - WINDOW + 1
        at = back + 1


class _Suffixes:
    """Windows of several pieces of text: piece, start in the piece, place and hash of the anchor."""

    def __init__(self, pieces: list[bytes]):
        data = np.frombuffer(b" ".join(pieces), np.uint8)
        starts, ends = bounds(data != 32)
        self.hashes = word_hashes(data, starts, ends)
        sizes = np.array([p.count(b" ") + 1 if p else 0 for p in pieces], np.int64)
        piece = np.repeat(np.arange(len(pieces)), sizes)
        n = len(starts) - WINDOW + 1
        if n <= 0:
            self.at = self.piece = self.start = self.anchor = np.zeros(0, np.int64)
            self.anchor_hash = np.zeros(0, np.uint64)
            return
        grams = self._rolled(GRAM)
        best, where = grams[SPAN - 1 : SPAN - 1 + n].copy(), np.full(n, SPAN - 1, np.int8)
        for j in range(SPAN - 2, -1, -1):
            less = grams[j : j + n] <= best
            best[less] = grams[j : j + n][less]
            where[less] = j
        self.at = np.flatnonzero(piece[:n] == piece[WINDOW - 1 :])
        first = (np.cumsum(sizes) - sizes)[piece[self.at]]
        self.piece, self.start = piece[self.at], self.at - first
        self.anchor, self.anchor_hash = self.start + where[self.at], best[self.at]

    def _rolled(self, size: int) -> np.ndarray:
        n = len(self.hashes) - size + 1
        out = np.zeros(n, np.uint64)
        for j in range(size):
            out = out * np.uint64(0xC2B2AE3D27D4EB4F) + self.hashes[j : j + n]
        return mix(out)

    def keys(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Five and ten words in one number (32 bits each), and all twenty."""
        at, step = self.at[which], self._rolled(STEP)
        return (step[at] & np.uint64(0xFFFFFFFF00000000)) | (step[at + STEP] >> np.uint64(32)), self._rolled(WINDOW)[at]


def _blocks(texts: Iterator[tuple[int, bytes]]) -> Iterator[tuple[list[int], list[int], _Suffixes]]:
    """(number of the text, word) of each piece, and the suffixes of about BLOCK bytes of pieces."""
    rows, words, pieces, size = [], [], [], 0
    for i, joined in texts:
        for piece, word in _chunks(joined):
            rows.append(i)
            words.append(word)
            pieces.append(piece)
            size += len(piece)
            if size >= BLOCK:
                yield rows, words, _Suffixes(pieces)
                rows, words, pieces, size = [], [], [], 0
    if pieces:
        yield rows, words, _Suffixes(pieces)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number and hash of the words of each text, and its anchors."""
    names = ["id", "body", "n_words", "sha", "anchors", "places"]
    for whole in batches:
        for begin in range(0, len(whole), 256):
            batch = whole.slice(begin, 256)
            counts, shas = [], []
            anchors = [[] for _ in range(len(batch))]
            places = [[] for _ in range(len(batch))]

            def texts(batch=batch, counts=counts, shas=shas):
                for i, text in enumerate(batch.column("text")):
                    joined = _joined(text.as_py())
                    counts.append(joined.count(b" ") + 1 if joined else 0)
                    shas.append(hashlib.sha256(joined).hexdigest())
                    yield i, joined

            for rows, words, found in _blocks(texts()):
                if not len(found.at):
                    continue
                base = np.array(words, np.int64)[found.piece]
                row = np.array(rows, np.int64)[found.piece]
                place = base + found.anchor
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1])
                row, place, hashes = row[new], place[new], found.anchor_hash[new].view(np.int64)
                cut = np.flatnonzero(np.diff(row)) + 1
                for r, p, h in zip(row[np.concatenate(([0], cut))], np.split(place, cut), np.split(hashes, cut)):
                    places[r].append(p)
                    anchors[r].append(h)
            none = np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("body"), pa.array(counts, pa.int64()), pa.array(shas, pa.string()),
                 pa.array([np.concatenate(x) if x else none for x in anchors], pa.list_(pa.int64())),
                 pa.array([np.concatenate(x) if x else none for x in places], pa.list_(pa.int64()))],
                names=names,
            )


def _gathered(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[np.ndarray]]:
    """Columns of HELD rows at a time."""
    held, rows = [], 0
    for batch in batches:
        held.append([batch.column(c).to_numpy() for c in names])
        rows += len(batch)
        if rows >= HELD:
            yield [np.concatenate(x) for x in zip(*held)]
            held, rows = [], 0
    if rows:
        yield [np.concatenate(x) for x in zip(*held)]


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of a task: ``lead`` is the one that stands for its equals, ``known`` says that it has some. The
    others need no look-up any more and are dealt by their place."""
    for h, row, place in _gathered(batches, ["h", "row", "place"]):
        order = np.argsort(h, kind="stable")
        h, row, place = h[order], row[order], place[order]
        lead = np.ones(len(h), bool)
        lead[1:] = h[1:] != h[:-1]
        known = ~lead
        known[:-1] |= ~lead[1:]
        target = np.where(lead, h, mix(row.view(np.uint64) + place.view(np.uint64)).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(target), pa.array(row), pa.array(place), pa.array(lead), pa.array(known)],
            names=["target", "row", "place", "lead", "known"],
        )


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by (target, lead) to the places whose anchor occurs elsewhere too."""
    held = None  # the last lead, which may have an equal in the next batch
    for batch in batches:
        t, row, place = (batch.column(c).to_numpy() for c in ("target", "row", "place"))
        lead, known = (batch.column(c).to_numpy(zero_copy_only=False).copy() for c in ("lead", "known"))
        if held is not None:
            t, row, place = (np.concatenate((a, b)) for a, b in zip(held[:3], (t, row, place)))
            lead, known = (np.concatenate((a, b)) for a, b in zip(held[3:], (lead, known)))
        same = (t[1:] == t[:-1]) & lead[1:] & lead[:-1]
        known[1:] |= same
        known[:-1] |= same
        held = [x[-1:] for x in (t, row, place, lead, known)]
        yield pa.RecordBatch.from_arrays([pa.array(row[:-1][known[:-1]]), pa.array(place[:-1][known[:-1]])], names=["row", "place"])
    if held is not None and held[4][0]:
        yield pa.RecordBatch.from_arrays([pa.array(held[1]), pa.array(held[2])], names=["row", "place"])


def _open_windows(batch: pa.RecordBatch):
    """Windows whose anchor is among ``places``, block by block: (row numbers, starts, suffixes, which)."""
    wanted = [np.sort(np.array(p.values)) for p in batch.column("places")]
    texts = ((i, _joined(t.as_py())) for i, t in enumerate(batch.column("text")))
    for rows, words, found in _blocks(texts):
        if not len(found.at):
            continue
        row, base = np.array(rows, np.int64)[found.piece], np.array(words, np.int64)[found.piece]
        place, open_ = base + found.anchor, np.zeros(len(row), bool)
        cut = np.concatenate(([0], np.flatnonzero(np.diff(row)) + 1, [len(row)]))
        for a, b in zip(cut[:-1], cut[1:]):
            mine = wanted[row[a]]
            at = np.minimum(np.searchsorted(mine, place[a:b]), len(mine) - 1)
            open_[a:b] = mine[at] == place[a:b]
        which = np.flatnonzero(open_)
        yield row[which], (base + found.start)[which], found, which


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes that may have equals, the earliest of equal ones in a task's block."""
    held, rows = [], 0

    def out():
        a, w, rank, start = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((start, rank, w, a))
        a, w, rank, start = a[order], w[order], rank[order], start[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (w[1:] != w[:-1])
        return pa.RecordBatch.from_arrays(
            [pa.array(x[new].view(np.int64)) for x in (a, w, rank, start)], names=["a", "w", "rank", "start"]
        )

    for whole in batches:
        for begin in range(0, len(whole), 256):
            batch = whole.slice(begin, 256)
            ranks = batch.column("rank").to_numpy()
            for row, start, found, which in _open_windows(batch):
                held.append([*found.keys(which), ranks[row], start])
                rows += len(row)
                if rows >= HELD:
                    yield out()
                    held, rows = [], 0
    if rows:
        yield out()


def _earliest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sorted leaves of a subtree to the first leaf below each node of WINDOW words."""
    last = None
    for batch in batches:
        if not len(batch):
            continue
        a, w = batch.column("a").to_numpy(), batch.column("w").to_numpy()
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (w[1:] != w[:-1])
        new[0] = last != (a[0], w[0])
        last = (a[-1], w[-1])
        yield batch.select(["rank", "start"]).filter(pa.array(new))


def _removed(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, len(whole), 256):
                batch = whole.slice(begin, 256)
                first = [np.array(x.as_py() or [], np.int64) for x in batch.column("first")]
                gone = [[] for _ in range(len(batch))]
                for row, start, _, _ in _open_windows(batch):
                    for r in np.unique(row):
                        gone[r].append(start[row == r])
                counts, shas = [], []
                for i, text in enumerate(batch.column("text")):
                    joined = _joined(text.as_py())
                    n = joined.count(b" ") + 1 if joined else 0
                    starts = np.setdiff1d(np.concatenate(gone[i]), first[i]) if gone[i] else np.zeros(0, np.int64)
                    change = np.zeros(n + 1, np.int32)
                    change[starts] += 1
                    change[starts + window] -= 1
                    kept = np.cumsum(change[:-1]) == 0
                    counts.append(n - int(kept.sum()))
                    begins, ends = bounds(np.frombuffer(joined, np.uint8) != 32)
                    runs = zip(*bounds(kept))
                    shas.append(hashlib.sha256(b" ".join(joined[begins[a] : ends[b - 1]] for a, b in runs)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row"), pa.array(counts, pa.int64()), pa.array(shas, pa.string())], names=["row", "gone", "rest"]
                )

    return run


def _wanted(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose ``body`` may be among ``keys``: a bit map of fixed size, so most texts that aren't
    needed don't travel; the exact join comes after it."""

    spot = F.shiftrightunsigned(F.xxhash64("body"), 64 - BITS)
    slots = keys.select(spot.alias("s")).selectExpr("cast(s div 32 as int) AS slot", "shiftleft(1L, cast(s % 32 as int)) AS bit")
    found = slots.groupBy("slot").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most 2**BITS bits
    table = np.zeros(1 << (BITS - 5), "<u4")
    table[found.column("slot").to_numpy()] = found.column("bits").to_numpy().astype(np.uint32)
    bits = docs.sparkSession.sparkContext.broadcast(table.view(np.uint8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = batch.column("s").to_numpy()
            yield batch.select(["body", "text"]).filter(pa.array((bits.value[s >> 3] >> (s & 7).astype(np.uint8)) & 1 == 1))

    return docs.select("body", "text", spot.alias("s")).mapInArrow(run, "body binary, text string")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_removed, kept_sha256 (of the kept words joined by blanks).

    A word is removed if a window of WINDOW words around it also starts earlier: in a row with a smaller id, or
    earlier in the same row. Rows that repeat an id come in the order in which they are read, rows without an id come
    last. Null and empty texts have no words. An empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    text = whole_text(text_col)
    name = F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit("-"))
    body = F.unhex(F.md5(F.concat(name, F.lit("\n"), text).cast("binary")))
    rows = docs.select(F.col(id_col).alias("id"), body.alias("body"), text.alias("text"))
    schema = T.StructType([rows.schema["id"], *T._parse_datatype_string("body binary, n_words long, sha string, anchors array<long>, places array<long>").fields])
    read = keep(rows.mapInArrow(_read, schema).withColumn("row", F.monotonically_increasing_id()), "repeats-read")

    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    winners = read.groupBy("sha").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("copies"))
    winners = keep(winners.select("sha", F.col("first.row").alias("first"), "copies"), "repeats-winners")
    own = F.col("row") == F.col("first")
    info = keep(
        left_join_by_key(read.select("row", "id", "body", "n_words", "sha"), winners, "sha", "copies").withColumn("own", own).drop("first", "copies"),
        "repeats-info",
    )
    single = info.filter(F.col("own") & (F.col("n_words") >= WINDOW))
    numbered = single.select(F.lit(0).alias("g"), F.col("id").isNull().alias("none"), "id", "row", "body")
    ranks = running(numbered, "g", ["none", "id", "row"], [], "repeats-ranks").select("row", "body", F.col("nth").alias("rank"))

    mine = left_join_by_key(read.filter(F.col("n_words") >= WINDOW).select("row", "sha", "anchors", "places"), winners, "sha", "copies")
    anchors = mine.filter(own).select("row", F.explode(F.arrays_zip("anchors", "places")).alias("x"))
    anchors = anchors.select(F.col("x.anchors").alias("h"), "row", F.col("x.places").alias("place"))
    met = anchors.mapInArrow(_met, "target long, row long, place long, lead boolean, known boolean")
    dealt = met.repartition(task_count(spark), "target").sortWithinPartitions("target", "lead")
    places = dealt.mapInArrow(_repeated, "row long, place long").groupBy("row").agg(F.collect_list("place").alias("places"))
    asked = keep(places.join(ranks, "row"), "repeats-asked")

    texts = _wanted(rows, asked).groupBy("body").agg(F.first("text").alias("text"))
    held = keep(texts.join(asked, "body").select("row", "rank", "places", "text"), "repeats-texts")
    leaves = held.mapInArrow(_leaves, "a long, w long, rank long, start long")
    trees = leaves.repartitionByRange(task_count(spark), "a", "w").sortWithinPartitions("a", "w", "rank", "start")
    first = trees.mapInArrow(_earliest, "rank long, start long").groupBy("rank").agg(F.collect_list("start").alias("first"))
    cut = held.join(first, "rank", "left").select("row", "places", "text", "first")
    cut = cut.mapInArrow(_removed(WINDOW), "row long, gone long, rest string")

    copy = ~F.col("own") & (F.col("n_words") >= WINDOW)
    return info.join(cut, "row", "left").select(
        F.col("id").alias(id_col),
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0))).alias("n_removed"),
        F.when(copy, hashlib.sha256(b"").hexdigest()).otherwise(F.coalesce("rest", "sha")).alias("kept_sha256"),
    )
