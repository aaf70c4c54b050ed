"""Near duplicates by SimHash and a self-join of binary tries.

Fingerprint: A-Z in lower case, words ``[^\\x20\\x09-\\x0D]+``, shingles of ``width`` words with
repeats (a shorter text is one shingle, an empty one has fingerprint zero); a bit is 1 if it is set
in over half of the XXH64 values (seed 42) of the shingles.

Self-join: two fingerprints link if at most ``budget`` bits differ. The 64 bits are cut into SEGMENTS
runs of bits; of two linked fingerprints at least one run differs in at most budget // SEGMENTS
bits. So one trie is built for each run, with that run's bits at the top, and joined with itself:

- Top of the trie, in Spark: a node is the value of the run. A fingerprint goes to its own node
  (resident) and to the nodes that differ in one bit and have a smaller number (visitor), so every
  pair of nodes within the top's budget meets at exactly one node. Only distinct fingerprints
  travel, 17 bytes for each of about 12 nodes a run.
- Below, in the tasks: pairs of sub-nodes are walked together, level by level; the differing bits
  accumulate and a pair is dropped as soon as they exceed the budget. Pairs of small nodes are
  compared leaf by leaf.

Linked fingerprints of a node are merged at once: a task returns at most one link for each
fingerprint and node, never the pairs of a dense group. Components of these links are the components
of all links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, keep, left_join_by_key, whole_text
from .components import components

WIDTH = 4
BUDGET = 4
BITS = 64
SEGMENTS = 3
#: Hashes that are added up at once; bounds the memory of a very long text.
BLOCK = 1 << 14
#: Sub-node pairs with at most so many leaf pairs are compared leaf by leaf.
LEAF_PAIRS = 64
#: Leaf pairs compared at once in a task.
CHUNK = 1 << 20


# --- fingerprints -------------------------------------------------------------------


def shingle_hashes(text: str, width: int = WIDTH, seed: int = 42) -> list[int]:
    """XXH64 of every shingle of one whole text, repeats included."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    if len(words) < width:
        return [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    first, last = starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], seed) for a, b in zip(first, last)]


def fingerprint(text: str, width: int = WIDTH, seed: int = 42) -> int:
    """The fingerprint of one whole text as an unsigned number."""
    hashes = shingle_hashes(text, width, seed)
    return _majority(hashes) if hashes else 0


def _majority(hashes: list[int]) -> int:
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), BLOCK):
        block = np.array(hashes[at : at + BLOCK], dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def _fingerprints(width: int, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t, width) for t in batch.column("text").to_pylist()]
            signed = np.array(found, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(signed)], names=["id", "fp"])

    return run


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(id, fp): the fingerprint of every row as a signed 64-bit number; null texts count as empty."""
    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    schema = T.StructType([rows.schema["id"], T.StructField("fp", T.LongType())])
    return rows.mapInArrow(_fingerprints(width, None), schema)


# --- links --------------------------------------------------------------------------


def _segments(bits: int = BITS, parts: int = SEGMENTS) -> list[tuple[int, int]]:
    """(lowest bit, number of bits) of each run."""
    cuts = [bits * i // parts for i in range(parts + 1)]
    return [(lo, hi - lo) for lo, hi in zip(cuts, cuts[1:])]


def _visits(fps: DataFrame, budget: int) -> DataFrame:
    """(trie, node, fp, visitor) for every node at which a fingerprint has to be seen."""
    if budget // SEGMENTS > 1:
        raise ValueError(f"budget may be at most {2 * SEGMENTS - 1}")
    places = []
    for trie, (low, size) in enumerate(_segments()):
        node = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << size) - 1))
        here = [F.struct(F.lit(trie).alias("trie"), node.alias("node"), F.lit(False).alias("visitor"))]
        if budget >= SEGMENTS:
            here += [
                F.when(
                    node.bitwiseAND(F.lit(1 << i)) != 0,
                    F.struct(
                        F.lit(trie).alias("trie"),
                        node.bitwiseXOR(F.lit(1 << i)).alias("node"),
                        F.lit(True).alias("visitor"),
                    ),
                )
                for i in range(size)
            ]
        places += here
    spots = F.filter(F.array(*places), lambda p: p.isNotNull())
    return fps.select("fp", F.explode(spots).alias("p")).select(
        F.col("p.trie").cast("byte").alias("trie"), F.col("p.node").cast("int").alias("node"), "fp", F.col("p.visitor").alias("visitor")
    )


class _Sets:
    """Disjoint sets over 0..n-1, merged in bulk; a member's label is the smallest of its set."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def merge(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while True:
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            low, high = np.minimum(x, y), np.maximum(x, y)
            root = np.arange(len(label))
            np.minimum.at(root, high, low)
            while True:  # follow roots to the end
                deeper = root[root]
                if (deeper == root).all():
                    break
                root = deeper
            self.label = label = root[label]


def _bit_count(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _split(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """For each range of sorted values that agree above ``bit``: where the ones of ``bit`` begin."""
    mask = np.uint64(1) << np.uint64(bit)
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():  # binary search in all ranges at once
        mid = (lo + hi) // 2
        one = np.zeros(len(lo), bool)
        one[open_] = (values[mid[open_]] & mask) != 0
        hi = np.where(open_ & one, mid, hi)
        lo = np.where(open_ & ~one, mid + 1, lo)
    return lo


def walk(keys: np.ndarray, pairs: np.ndarray, budget: int, sets: _Sets) -> None:
    """Walk pairs of trie nodes down together and merge the leaves within ``budget`` bits.

    ``keys``: fingerprints, turned so that the trie's top bits come first; sorted within each range.
    ``pairs``: rows (lo1, hi1, lo2, hi2): two nodes as ranges of ``keys``; equal ranges for a node with itself.
    """
    stack = [(pairs, BITS - 1)]
    while stack:
        pairs, bit = stack.pop()
        if len(pairs) > CHUNK // 16:
            half = len(pairs) // 2
            stack += [(pairs[:half], bit), (pairs[half:], bit)]
            continue
        size = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2])
        pairs, size = pairs[size > 0], size[size > 0]
        small = (size <= LEAF_PAIRS) | (bit < 0)
        if small.any():
            _leaves(keys, pairs[small], size[small], budget, sets)
        pairs = pairs[~small]
        if not len(pairs):
            continue
        own = (pairs[:, 0] == pairs[:, 2]) & (pairs[:, 1] == pairs[:, 3])
        # Bits above ``bit`` agree within a node, so its first key stands for them.
        m1 = _split(keys, pairs[:, 0], pairs[:, 1], bit)
        m2 = _split(keys, pairs[:, 2], pairs[:, 3], bit)
        a, b, c, d = pairs.T
        other = ~own
        kids = np.concatenate(
            [
                np.stack([a, m1, c, m2], 1),
                np.stack([m1, b, m2, d], 1),
                np.stack([a, m1, m2, d], 1),
                np.stack([m1, b, c, m2], 1)[other],
            ]
        )
        kids = kids[(kids[:, 0] < kids[:, 1]) & (kids[:, 2] < kids[:, 3])]
        differ = _bit_count((keys[kids[:, 0]] ^ keys[kids[:, 2]]) >> np.uint64(bit))
        kids = kids[differ <= budget]
        # Nothing is left to find in a pair of nodes whose leaves are all one set already.
        label = sets.label
        one = label[kids[:, 0]] == label[kids[:, 2]]
        if one.any():
            change = np.concatenate(([0], np.cumsum(label[1:] != label[:-1])))
            whole = (change[kids[:, 1] - 1] == change[kids[:, 0]]) & (change[kids[:, 3] - 1] == change[kids[:, 2]])
            kids = kids[~(one & whole)]
        if len(kids):
            stack.append((kids, bit - 1))


def _leaves(keys, pairs, size, budget, sets) -> None:
    """Compare the leaves of each pair of nodes; no more than CHUNK comparisons at once."""
    at, total = 0, np.cumsum(size)
    while at < len(pairs):
        done = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + CHUNK, "right")))
        p, n = pairs[at:to], size[at:to]
        begin = np.repeat(np.cumsum(n) - n, n)
        k = np.arange(int(n.sum())) - begin
        wide = np.repeat(p[:, 3] - p[:, 2], n)
        i = np.repeat(p[:, 0], n) + k // wide
        j = np.repeat(p[:, 2], n) + k % wide
        near = (i != j) & (_bit_count(keys[i] ^ keys[j]) <= budget)
        if near.any():
            sets.merge(i[near], j[near])
        at = to


def _join_block(trie, node, fp, visitor, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among the rows of whole nodes, one for each row that isn't its set's first."""
    low, size = _segments()[trie[0]] if len(trie) else (0, 0)
    keys = np.empty(len(fp), np.uint64)
    for t in np.unique(trie):
        low, size = _segments()[t]
        top = np.uint64(low + size)
        x = fp[trie == t]
        keys[trie == t] = x if top == BITS else (x << (np.uint64(BITS) - top)) | (x >> top)
    order = np.lexsort((keys, visitor, node, trie))
    trie, node, fp, visitor, keys = trie[order], node[order], fp[order], visitor[order], keys[order]
    new = np.concatenate(([True], (node[1:] != node[:-1]) | (trie[1:] != trie[:-1])))
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(fp))
    guests = np.add.reduceat(visitor.astype(np.int64), begin)
    mid = end - guests
    live = (mid > begin) & (end - begin > 1)
    begin, mid, end = begin[live], mid[live], end[live]
    if not len(begin):
        return fp[:0], fp[:0]
    sets = _Sets(len(fp))
    # Neighbours in sorted order settle most of a dense group before any pair of nodes is walked.
    i = np.arange(len(fp) - 1)
    side = (_bit_count(keys[i] ^ keys[i + 1]) <= budget) & ~new[1:]
    sets.merge(i[side], i[side] + 1)
    own = np.stack([begin, mid, begin, mid], 1)
    across = np.stack([begin, mid, mid, end], 1)
    walk(keys, np.concatenate([own, across]), budget, sets)
    linked = np.flatnonzero(sets.label != np.arange(len(fp)))
    return fp[linked], fp[sets.label[linked]]


def _links(budget: int):
    """Rows sorted by (trie, node) to links; a node that several batches share is held until it ends."""
    least = 1 << 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows, target = 0, least

        def columns():
            return [np.concatenate(x) for x in zip(*held)]

        def out(block):
            a, b = _join_block(*block, budget)
            return pa.RecordBatch.from_arrays(
                [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"]
            )

        for batch in batches:
            held.append(
                [
                    batch.column("trie").to_numpy(),
                    batch.column("node").to_numpy(),
                    batch.column("fp").to_numpy().view(np.uint64),
                    batch.column("visitor").to_numpy(zero_copy_only=False),
                ]
            )
            rows += len(batch)
            if rows < target:
                continue
            block = columns()
            last = (block[0] == block[0][-1]) & (block[1] == block[1][-1])
            cut = len(last) - int(last.sum())
            if cut:
                yield out([x[:cut] for x in block])
            held = [[x[cut:] for x in block]]
            rows = len(block[0]) - cut
            target = max(least, 2 * rows)  # what is held is copied only when it has doubled
        if held and rows:
            yield out(columns())

    return run


def links(fps: DataFrame, budget: int = BUDGET) -> DataFrame:
    """``fps(fp)``, distinct, to links (a, b) of fingerprints whose components are those of all pairs
    within ``budget`` bits. At most one link for each fingerprint and node."""
    spark = fps.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = _visits(fps, budget).repartition(parts, "trie", "node").sortWithinPartitions("trie", "node")
    return dealt.mapInArrow(_links(budget), "a long, b long")


# --- the operator -------------------------------------------------------------------


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, budget: int = BUDGET
) -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 hex digits), component_id.

    - component_id is the smallest id reachable over links, the row's own included. Rows with equal
      fingerprints always share it, so do all texts without a word (fingerprint zero; null texts too).
    - Rows that repeat an id get a row each. Null ids are never the smallest while another exists;
      a component of null ids only has a null component_id.
    - An empty table gives an empty result. Other columns of ``docs`` are ignored.
    """
    rows = keep(with_fingerprints(docs, id_col, text_col, width), "simhash-rows")
    fps = keep(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "simhash-fps")
    roots = components(keep(links(fps.select("fp"), budget), "simhash-links")).withColumnRenamed("node", "fp")
    placed = keep(fps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "simhash-placed")
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("m"))
    named = keep(
        left_join_by_key(placed.select("fp", "n", "root"), keep(least, "simhash-roots"), "root", "m").select("fp", "n", "component_id"),
        "simhash-named",
    )
    out = left_join_by_key(rows, named, "fp", "n")
    return out.select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _tagged(docs: DataFrame, text_col: str, width: int, name: str) -> DataFrame:
    """``docs`` with the fingerprint of each row as column ``name``."""
    schema, at = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py() or "", width) for t in batch.column(at)]
            signed = pa.array(np.array(found, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, signed], names=schema.names)

    return docs.mapInArrow(run, schema)


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, budget: int = BUDGET
) -> DataFrame:
    """One row of ``docs`` for each component, all columns kept: the one with its smallest id.

    Texts link if their fingerprints differ in at most ``budget`` bits. Rows that repeat an id are judged by
    their fingerprints. Rows without an id stay, as no later step could name them.
    """
    key = fresh("fp", docs.columns)
    tagged = keep(_tagged(docs, text_col, width, key), "near-tagged")
    named = tagged.filter(F.col(id_col).isNotNull())
    keys = keep(tagged.groupBy(F.col(key).alias("fp")).agg(F.min(id_col).alias("least")), "near-keys")
    roots = components(keep(links(keys.select("fp"), budget), "near-links")).withColumnRenamed("node", "fp")
    placed = keys.filter("least IS NOT NULL").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    first = placed.groupBy("root").agg(F.min(F.struct("least", "fp")).alias("first"))
    first = first.select(F.col("first.least").alias(id_col), F.col("first.fp").alias(key))
    kept = named.join(first, [id_col, key], "left_semi").dropDuplicates([id_col, key])
    return kept.unionByName(tagged.filter(F.col(id_col).isNull())).select(docs.columns)
