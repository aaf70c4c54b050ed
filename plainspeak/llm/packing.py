"""Best-fit packing of token sequences, bulk-synchronous.

Documents become pieces of at most ``size`` tokens: only longer documents are cut, the first piece
takes the remainder. Pieces and the gaps of open sequences are kept range-sorted by length, as
classes of equal length, of which there are at most ``size`` however large the input is. Longest
class first, a round

1. finds the successor of the class among the gaps (the smallest gap that is large enough),
2. matches the two classes by rank: the k-th unplaced piece takes the k-th such gap, so no gap is
   taken twice, and as many pieces are placed at once as the smaller side has,
3. updates the gaps, and repeats until the class is placed; what finds no gap opens new sequences.

A piece's rank within its class is counted in Spark: each task counts its own pieces, the sizes of
the tasks before are added. The rounds work on class counts (at most ``size`` numbers from the
cluster) and give a table of moves: "ranks r..r+n of length L go to sequences s..s+n at offset o".
Every task then places its pieces by binary search in that table.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, whole_text
from .tokens import Encoder

SIZE = 1024
END = 2

_PIECES = (
    "id {id}, piece int, start bigint, length bigint, ids_crc32 bigint, task int, place bigint"
)


def cut_lengths(n: int, size: int = SIZE) -> list[int]:
    """Lengths of the pieces of a document of ``n`` tokens: the first takes the remainder."""
    first = n % size
    return ([first] if first else []) + [size] * (n // size)


def _pieces(size: int, vocabulary: str | None, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        encoder = Encoder(vocabulary, added=True)
        seen = np.zeros(size + 1, np.int64)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                row, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, text in enumerate(part.column("text")):
                    found = encoder.encode(text.as_py())
                    found.append(END)
                    data = np.frombuffer(found, np.uint32).astype("<u4").tobytes()
                    begin = 0
                    for k, n in enumerate(cut_lengths(len(found), size)):
                        mine = data[4 * begin : 4 * (begin + n)]
                        row.append(i)
                        piece.append(k)
                        start.append(begin)
                        length.append(n)
                        crc.append(zlib.crc32(mine))
                        if with_ids:
                            ids.append(mine)
                        begin += n
                lengths = np.array(length, np.int64)
                order = np.argsort(lengths, kind="stable")
                ranked = lengths[order]
                first = np.searchsorted(ranked, ranked)
                place = np.empty(len(lengths), np.int64)
                place[order] = np.arange(len(lengths)) - first + seen[ranked]
                seen += np.bincount(lengths, minlength=size + 1)
                columns = [
                    part.column("id").take(pa.array(row, pa.int32())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(lengths),
                    pa.array(crc, pa.int64()),
                    pa.array(np.full(len(lengths), task, np.int32)),
                    pa.array(place),
                ]
                names = ["id", "piece", "start", "length", "ids_crc32", "task", "place"]
                if with_ids:
                    columns.append(pa.array(ids, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def best_fit(counts: dict[int, int], size: int = SIZE) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Moves (length, first rank, pieces, first sequence, offset) for ``counts`` pieces of each length,
    and the number of sequences. Pure class arithmetic: its work depends on ``size`` only."""
    moves: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first sequence, how many)
    open_gaps: list[int] = []  # the gaps present, sorted
    opened = 0

    def add(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(open_gaps, gap)
            gaps[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(open_gaps, length)
            if at == len(open_gaps):  # no gap is large enough
                gap, first, n = size, opened, -(-left // (size // length))
                opened += n
            else:
                gap = open_gaps[at]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    open_gaps.pop(at)
            used = min(n, left)
            moves.append((length, rank, used, first, size - gap))
            rank, left = rank + used, left - used
            add(gap - length, first, used)
            add(gap, first + used, n - used)
    return moves, opened


def _placed(moves: list[tuple[int, int, int, int, int]]):
    table: dict[int, np.ndarray] = {}
    for length in {m[0] for m in moves}:
        table[length] = np.array([m[1:] for m in moves if m[0] == length], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(batch), np.int64), np.empty(len(batch), np.int64)
            for n in np.unique(length):
                mine, t = length == n, table[int(n)]
                k = np.searchsorted(t[:, 0], rank[mine], "right") - 1
                sequence[mine] = t[k, 2] + rank[mine] - t[k, 0]
                offset[mine] = t[k, 3]
            keep_columns = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep_columns] + [pa.array(sequence), pa.array(offset)],
                names=[*keep_columns, "sequence_id", "offset"],
            )

    return run


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SIZE,
    vocabulary: str | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset (and its ids, as
    little-endian unsigned 32-bit numbers, if ``with_ids``).

    A null or empty text is its end mark alone: one piece of one token. Rows that repeat an id, and
    null ids, are packed like any other row. An empty table gives an empty result. ``vocabulary`` is
    the path of a tokenizer file that every executor can read (default: the installed one).
    """
    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = _PIECES.format(id=kind) + (", ids binary" if with_ids else "")
    pieces = keep(rows.mapInArrow(_pieces(size, vocabulary, with_ids), schema), "pack-pieces")
    sizes = keep(pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "pack-sizes")
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    counts = {r[0]: r[1] for r in sizes.groupBy("length").agg(F.sum("n")).collect()}  # at most ``size`` rows
    moves, _ = best_fit(counts, size)
    columns = ["id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    ranked = pieces.join(bases, ["length", "task"]).select(*columns, (F.col("base") + F.col("place")).alias("rank"))
    schema = ranked.drop("rank").schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(_placed(moves), schema).withColumnRenamed("id", id_col)
