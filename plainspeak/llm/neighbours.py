"""Nearest neighbours by shifted space-filling curves.

1. Every vector is projected, shifted and numbered along several Hilbert curves. Each curve is a
   range-partitioned sort in Spark, cut into blocks of ``block`` consecutive vectors.
2. The queries of a block are compared with their own block and its two neighbours on each curve; the
   windows of all curves merge, and the exact distance ranks what they found.
3. Vectors without structure (all directions alike, as many dimensions) have neighbours that no curve
   brings together. So the blocks of the first curve are visited as well, unless the distance of
   their centres shows that they can't hold anything nearer than what a query has; only what beats the
   windows' result is returned. On clustered vectors most blocks are skipped.

Blocks travel as packed rows (numbers and a matrix), so a comparison is a product of two small matrices.
Of equal vectors the k + 1 smallest ids are indexed: the others can't be among the k nearest, as ties go
to the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep

K = 10
CURVES = 4
BLOCK = 512
#: Projected dimensions and bits of each; together one key of at most 62 bits.
DIMENSIONS, KEY_BITS = 8, 7
SEED = 17
#: Blocks whose queries share one pass over the index.
QUERY_BLOCKS = 64
#: Packed rows that a task holds at once.
ROWS_AT_ONCE = 32
_EPSILON = 1e-9


# --- curves -------------------------------------------------------------------------


def hilbert(points: np.ndarray, bits: int = KEY_BITS) -> np.ndarray:
    """Numbers of integer points (rows, 0 <= x < 2**bits) along the Hilbert curve, for any dimension."""
    x = points.T.astype(np.int64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the turns of the cells, largest first
        p = q - 1
        for i in range(n):
            turned = (x[i] & q) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(turned, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def curve_keys(vectors: np.ndarray, curve: int, spread: float, seed: int = SEED) -> np.ndarray:
    """Keys on one curve: its own projection and shift; ``spread`` is the usual size of a component."""
    random = np.random.default_rng([seed, curve])
    dimension = vectors.shape[1]
    axes = random.standard_normal((dimension, DIMENSIONS)) / math.sqrt(dimension)
    shift = random.uniform(-0.25, 0.25, DIMENSIONS)
    unit = spread * math.sqrt(dimension) if spread > 0 else 1.0
    place = vectors @ (axes * math.sqrt(dimension)) / (8 * unit / math.sqrt(dimension)) + 0.5 + shift
    cells = np.clip(place * (1 << KEY_BITS), 0, (1 << KEY_BITS) - 1)
    return hilbert(cells.astype(np.int64))


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)


def _keys(dimension: int, curves: int, spread: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vector"), dimension)
            for curve in range(curves):
                keys = curve_keys(x, curve, spread, seed) if len(x) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(x), curve, np.int32)), pa.array(keys), batch.column("id"),
                        batch.column("vector"), batch.column("candidate"), batch.column("query"),
                    ],
                    names=["curve", "key", "id", "vector", "candidate", "query"],
                )

    return run


_BLOCKS = "curve int, part int, place int, ids binary, matrix binary, q_ids binary, q_matrix binary, queries array<long>"


def _blocks(dimension: int, block: int):
    """Sorted rows to blocks of consecutive candidates; a block also carries the queries among its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, place, held = TaskContext.get().partitionId(), 0, []

        def packed(rows):
            nonlocal place
            curve, ids, x, candidate, query = rows
            place += 1
            data = [
                [int(curve[0])], [part], [place - 1],
                [ids[candidate].tobytes()], [x[candidate].tobytes()], [ids[query].tobytes()], [x[query].tobytes()],
                [ids[query].tolist()],
            ]
            kinds = [pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 4, pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays(
                [pa.array(d, k) for d, k in zip(data, kinds)],
                names=["curve", "part", "place", "ids", "matrix", "q_ids", "q_matrix", "queries"],
            )

        def cut(final: bool):
            nonlocal held
            rows = [np.concatenate(c) for c in zip(*held)]
            at = 0
            while at < len(rows[0]):
                same = int(np.searchsorted(rows[0], rows[0][at], "right"))  # blocks don't mix curves
                to = min(at + block, same)
                if not final and to == len(rows[0]) and to - at < block:
                    break
                yield packed([c[at:to] for c in rows])
                at = to
            held = [[c[at:] for c in rows]] if at < len(rows[0]) else []

        for batch in batches:
            if not len(batch):
                continue
            held.append(
                [
                    batch.column("curve").to_numpy(), batch.column("id").to_numpy(),
                    _matrix(batch.column("vector"), dimension),
                    batch.column("candidate").to_numpy(zero_copy_only=False), batch.column("query").to_numpy(zero_copy_only=False),
                ]
            )
            yield from cut(False)
        if held:
            yield from cut(True)

    return run


def _numbered(blocks: DataFrame) -> DataFrame:
    """Blocks with ``seq``: their place along all curves. The driver gets one number a task."""
    sizes = {r[0]: r[1] for r in blocks.groupBy("part").count().collect()}
    counts = [sizes.get(i, 0) for i in range(max(sizes, default=0) + 1)]
    starts = list(accumulate([0, *counts[:-1]]))
    first = F.element_at(F.array(*[F.lit(s).cast("long") for s in starts]), F.col("part") + 1)
    return blocks.withColumn("seq", first + F.col("place"))


# --- comparison ---------------------------------------------------------------------


def nearest(q_ids, q, ids, x, k: int, bound: np.ndarray | None = None, bound_id: np.ndarray | None = None):
    """(query id, id, distance) of the k nearest rows of ``x`` to each row of ``q``, the query's own id left
    out, ties to the smaller id; only those that come before (bound, bound_id)."""
    if not len(q_ids) or not len(ids):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    about = (q * q).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * q @ x.T
    scale = _EPSILON * (1 + (q * q).sum(1))
    limit = np.full(len(q), np.inf)
    if len(ids) > k + 1:
        limit = np.partition(about, k, axis=1)[:, k] + scale
    if bound is not None:
        limit = np.minimum(limit, bound * bound + scale)
    i, j = np.nonzero((about <= limit[:, None]) & (ids[None] != q_ids[:, None]))
    d = np.sqrt(((q[i] - x[j]) ** 2).sum(1))
    if bound is not None:
        better = (d < bound[i]) | ((d == bound[i]) & (ids[j] < bound_id[i]))
        i, j, d = i[better], j[better], d[better]
    order = np.lexsort((ids[j], d, i))
    i, j, d = i[order], j[order], d[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    best = rank < k
    return q_ids[i[best]], ids[j[best]], d[best]


def _compared(dimension: int, k: int, bounded: bool):
    def numbers(value, kind=np.int64):
        return np.frombuffer(value.as_py(), kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                q_ids, ids = numbers(batch.column("q_ids")[r]), numbers(batch.column("ids")[r])
                q = numbers(batch.column("q_matrix")[r], np.float64).reshape(-1, dimension)
                x = numbers(batch.column("matrix")[r], np.float64).reshape(-1, dimension)
                limits = ()
                if bounded:
                    limits = numbers(batch.column("bounds")[r], np.float64), numbers(batch.column("bound_ids")[r])
                found = nearest(q_ids, q, ids, x, k, *limits)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["query_id", "vec_id", "score"])

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _packed_queries(dimension: int):
    """Queries with bounds, grouped: rows sorted by group to one packed row a group, with centre and reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def out(rows):
            group, ids, x, bound, bound_id = rows
            centre = x.mean(0)
            reach = float((np.sqrt(((x - centre) ** 2).sum(1)) + bound).max())
            data = [[int(group[0])], [ids.tobytes()], [x.tobytes()], [bound.tobytes()], [bound_id.tobytes()], [centre.tolist()], [reach]]
            kinds = [pa.int64(), *[pa.binary()] * 4, pa.list_(pa.float64()), pa.float64()]
            return pa.RecordBatch.from_arrays(
                [pa.array(d, t) for d, t in zip(data, kinds)],
                names=["group", "q_ids", "q_matrix", "bounds", "bound_ids", "q_centre", "q_reach"],
            )

        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch.column("vector"), dimension)
            held.append([batch.column("group").to_numpy(), batch.column("id").to_numpy(), x, batch.column("bound").to_numpy(), batch.column("bound_id").to_numpy()])
            rows = [np.concatenate(c) for c in zip(*held)]
            cut = int(np.searchsorted(rows[0], rows[0][-1]))
            at = 0
            while at < cut:
                to = int(np.searchsorted(rows[0], rows[0][at], "right"))
                yield out([c[at:to] for c in rows])
                at = to
            held = [[c[cut:] for c in rows]]
        if held and len(held[0][0]):
            yield out([np.concatenate(c) for c in zip(*held)])

    return run


def _summaries(dimension: int):
    """Centre and radius of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            centres, radii = [], []
            for value in batch.column("matrix"):
                x = np.frombuffer(value.as_py(), np.float64).reshape(-1, dimension)
                centre = x.mean(0) if len(x) else np.zeros(dimension)
                centres.append(centre.tolist())
                radii.append(float(np.sqrt(((x - centre) ** 2).sum(1)).max()) if len(x) else -1.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("seq"), pa.array(centres, pa.list_(pa.float64())), pa.array(radii, pa.float64())],
                names=["seq", "centre", "radius"],
            )

    return run


# --- the operator -------------------------------------------------------------------


def usable(vector: Column) -> Column:
    """Not null, not empty, every component finite, at least one not zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0)


def search(
    rows: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = K,
    curves: int = CURVES,
    block: int = BLOCK,
    complete: bool = True,
    seed: int = SEED,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its k nearest other rows by Euclidean distance in
    double precision, ties to the smaller id; all of them if there are fewer.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without an
    id, nor vectors of another length than the commonest. Rows that repeat an id are one neighbour, at their
    smallest distance, and never a neighbour of their own id. An empty table gives an empty result.
    ``complete=False`` leaves out step 3: fast at any size, with the recall that the curves alone give.
    """
    spark = rows.sparkSession
    vector = F.col(vector_col).cast("array<double>")
    given = rows.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector"), is_query.alias("query"))
    given = given.filter(F.col("id").isNotNull() & usable(F.col("vector"))).withColumn("query", F.coalesce("query", F.lit(False)))
    squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    shape = given.groupBy(F.size("vector").alias("size")).agg(F.count(F.lit(1)).alias("n"), F.avg(squares).alias("square"))
    commonest = shape.orderBy(F.desc("n"), F.desc("size")).first()
    result = "query_id long, rank int, vec_id long, score double"
    if commonest is None:
        return spark.createDataFrame([], result)
    dimension, spread = commonest["size"], math.sqrt(commonest["square"] / commonest["size"])
    same = Window.partitionBy("vector").orderBy("id")  # limited in the map tasks already
    given = given.filter(F.size("vector") == dimension)
    indexed = given.withColumn("copy", F.row_number().over(same)).filter(F.col("copy") <= k + 1).drop("copy")
    indexed = keep(indexed, "neighbours-indexed")
    # A query beyond the k + 1 smallest ids of its vector is no candidate, but stays a query.
    spare = given.filter("query").join(indexed.filter("query").drop("query"), ["id", "vector"], "left_anti")
    usable_rows = keep(
        indexed.select("id", "vector", F.lit(True).alias("candidate"), "query").unionByName(
            spare.select("id", "vector", F.lit(False).alias("candidate"), "query")
        ),
        "neighbours-rows",
    )
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    keyed = usable_rows.mapInArrow(
        _keys(dimension, curves, spread, seed),
        "curve int, key long, id long, vector array<double>, candidate boolean, query boolean",
    )
    ordered = keyed.repartitionByRange(parts, "curve", "key", "id").sortWithinPartitions("curve", "key", "id")
    blocks = keep(_numbered(keep(ordered.mapInArrow(_blocks(dimension, block), _BLOCKS), "neighbours-cut")), "neighbours-blocks")

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_AT_ONCE))  # packed rows are large
    try:
        windows = _windows(blocks, dimension, k)
        if not complete:
            return windows.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
        better = _completed(blocks, usable_rows, windows, dimension, k)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    out = _ranked(windows.select("query_id", "vec_id", "score").unionByName(better), k)
    return out.select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def _windows(blocks: DataFrame, dimension: int, k: int) -> DataFrame:
    """Step 2: the queries of each block against three blocks of each curve."""
    asking = blocks.filter(F.length("q_ids") > 0).select(
        "curve", "q_ids", "q_matrix", F.explode(F.expr("array(seq - 1, seq, seq + 1)")).alias("seq")
    )
    pairs = asking.join(blocks.select("curve", "seq", "ids", "matrix"), ["curve", "seq"])
    found = pairs.mapInArrow(_compared(dimension, k, False), "query_id long, vec_id long, score double")
    return keep(_ranked(keep(found, "neighbours-found"), k), "neighbours-windows")


def _completed(blocks: DataFrame, usable_rows: DataFrame, windows: DataFrame, dimension: int, k: int) -> DataFrame:
    """Step 3: what the first curve's blocks hold before each query's k-th neighbour so far."""
    last = windows.filter(F.col("rank") == k).select(
        F.col("query_id").alias("id"), F.col("score").alias("bound"), F.col("vec_id").alias("bound_id")
    )
    first = blocks.filter("curve = 0")
    at = F.floor(F.col("seq") / QUERY_BLOCKS).alias("group")
    home = first.select(F.explode("queries").alias("id"), at).groupBy("id").agg(F.min("group").alias("group"))
    queries = (
        usable_rows.filter("query").select("id", "vector")
        .join(home, "id")
        .join(last, "id", "left")
        .select("group", "id", "vector", F.coalesce("bound", F.lit(float("inf"))).alias("bound"), F.coalesce("bound_id", F.lit(2**63 - 1)).alias("bound_id"))
    )
    packed = keep(
        queries.repartition("group").sortWithinPartitions("group", "id").mapInArrow(
            _packed_queries(dimension),
            "group long, q_ids binary, q_matrix binary, bounds binary, bound_ids binary, q_centre array<double>, q_reach double",
        ),
        "neighbours-queries",
    )
    summary = keep(first.select("seq", "matrix").mapInArrow(_summaries(dimension), "seq long, centre array<double>, radius double"), "neighbours-summary")
    low, high = first.agg(F.min("seq"), F.max("seq")).first()
    gap = F.sqrt(
        F.aggregate(F.zip_with("q_centre", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    )
    visits = (
        packed.select("group", "q_centre", "q_reach", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("seq"))
        .join(summary, "seq")
        .filter((F.col("radius") >= 0) & (gap <= (F.col("q_reach") + F.col("radius")) * (1 + _EPSILON)))
        .select("group", "seq")
    )
    pairs = visits.join(packed.drop("q_centre", "q_reach"), "group").join(first.select("seq", "ids", "matrix"), "seq")
    return keep(
        pairs.mapInArrow(_compared(dimension, k, True), "query_id long, vec_id long, score double"), "neighbours-better"
    )
