"""The trie of conversation prefixes, rolled up by centroid decomposition.

A node of the trie is a distinct sequence of turns (role and text) with which conversations begin. Its key is
a 128-bit sum, over the turns, of the turn's digest mixed with its place: keys come from running sums over range-partitioned
turns, so a conversation with a third of all turns is dealt to many tasks. One aggregation of (conversation,
depth) rows gives the nodes with their members.

What a node sums over its subtree comes from a centroid decomposition of the parent-edge forest:

- A component is a connected part of the trie. ``sub`` is the number of (conversation, depth) rows at and below
  a node within its component: known at once from the members, no sweep over the tree is needed.
- The nodes with more than half of the component's rows are a path from its top; the last of them is the
  centroid. Everything at and below the centroid is added up and added to the nodes of this centroid-to-top
  path. Every pair of a node and a descendant is parted by exactly one centroid, so every value arrives once.
- Without its centroid a component falls into parts of at most half of its rows: the subtrees of the centroid's
  children and the rest above. Whether a node lies below a centroid is read off the path of the conversation
  the node is named after. Rounds are needed for the logarithm of the rows.

Components of more than PIECE nodes are split in Spark, one round for all of them; smaller ones (no matter how
many) are dealt to tasks, which split them to the end in the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, left_join_by_key, whole_text
from .ranges import running, task_count

#: Components of at most so many nodes are split by one task.
PIECE = 4_096
#: Nodes a task works on at once; whole components.
BLOCK = 1 << 16
#: Bytes of member lists that a task holds of one node.
LIST_BYTES = 1 << 20
MAX_ROUNDS = 200
BASE, KINDS = 100, 6


# --- rebuilt conversations and their keys -------------------------------------------


def _digests(id_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, chars = [], []
            for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist()):
                head = role.encode("utf-8", "surrogatepass")
                body = text.encode("utf-8", "surrogatepass")
                found.append(hashlib.blake2b(b"%d:%b%b" % (len(head), head, body), digest_size=16).digest())
                chars.append(len(text))
            pair = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv"), pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy()), pa.array(chars, pa.int64())],
                names=["conv", "d1", "d2", "chars"],
            )

    return run


def _mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digests of a turn mixed with its place, so that sums tell sequences apart."""
    for batch in batches:
        p = batch.column("p").to_numpy().view(np.uint64)
        out = [batch.column(c) for c in ("conv", "p", "n", "chars")]
        for name, odd in (("d1", 0x9E3779B97F4A7C15), ("d2", 0xC2B2AE3D27D4EB4F)):
            out.append(pa.array(_mix(_mix(batch.column(name).to_numpy().view(np.uint64)) + p * np.uint64(odd)).view(np.int64)))
        yield pa.RecordBatch.from_arrays(out, names=["conv", "p", "n", "chars", "k1", "k2"])


def _key(a: str, b: str) -> Column:
    return F.unhex(F.concat(*[F.lpad(F.hex(c), 16, "0") for c in (a, b)]))


def _root() -> Column:
    return F.lit(bytes(16))


def rebuilt_paths(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``turns(conv, turn, role, text)`` to the rebuilt conversations: (conv, n: turns) and the rows
    (conv, p, n, chars, k1, k2, p1, p2): depth, characters of the last text, key of the node and of its parent."""
    schema = f"conv {turns.schema['conv'].dataType.simpleString()}, d1 long, d2 long, chars long"
    own = keep(
        running(turns, "conv", ["turn", "role", "text"], [], "trie-turns", lambda x: x.mapInArrow(_digests("conv"), schema)),
        "trie-own",
    )
    convs = own.groupBy("conv").agg(F.max("nth").alias("own")).withColumn("base", F.col("conv") - F.col("conv") % BASE)
    convs = keep(convs.withColumn("h", F.crc32(F.col("conv").cast("string").cast("binary")) % KINDS), "trie-convs")
    bases = convs.filter("conv = base").select("base", F.col("own").alias("held"))  # at most 2 * BASE conversations a base
    heads = F.least("h", F.coalesce("held", F.lit(0)))
    info = convs.join(bases, "base", "left").withColumn("m", heads)
    info = keep(info.withColumn("n", F.col("m") + F.greatest(F.col("own") - F.col("h"), F.lit(0))), "trie-info")
    kept = left_join_by_key(own, info.select("conv", "own", "h", "m", "n"), "conv", "own").filter("nth > h")
    kept = kept.select("conv", (F.col("nth") - F.col("h") + F.col("m")).alias("p"), "n", "chars", "d1", "d2")
    first = own.filter((F.col("conv") % BASE == 0) & (F.col("nth") < KINDS))
    first = first.select(F.col("conv").alias("base"), F.col("nth").alias("p"), "chars", "d1", "d2")
    given = info.filter("m > 0").select("conv", "base", "m", "n").join(first, "base").filter("p <= m")
    both = kept.unionByName(given.select(kept.columns))
    schema = both.select("conv", "p", "n", "chars", F.col("d1").alias("k1"), F.col("d2").alias("k2")).schema
    summed = running(both, "conv", ["p"], ["k1", "k2"], "trie-sums", lambda x: x.mapInArrow(_placed, schema))
    rows = summed.select(
        "conv", "p", "n", "chars",
        F.col("sum_k1").alias("k1"), F.col("sum_k2").alias("k2"), F.col("before_k1").alias("p1"), F.col("before_k2").alias("p2"),
    )
    return info.select("conv", "n"), keep(rows, "trie-rows")


# --- subtree sums -------------------------------------------------------------------


def split_block(parent: np.ndarray, depth: np.ndarray, sub: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Subtree sums of ``values`` (rows: nodes) in whole components, by splitting them at centroids.

    ``parent``: place of the parent, -1 at a component's top. ``sub``: rows at and below each node.
    """
    n = len(parent)
    totals, sub, up = np.zeros_like(values), sub.copy(), parent.copy()
    here = np.arange(n)
    alive = np.ones(n, bool)
    while alive.any():
        top = _tops(up)
        heavy = alive & (2 * sub > sub[top])
        least = np.full(n, -1, np.int64)
        np.maximum.at(least, top[heavy], depth[heavy])
        centre = heavy & (depth == least[top])
        of_top = np.full(n, -1, np.int64)
        of_top[top[centre]] = here[centre]  # the centroid of each component, at its top
        owner = np.where(up >= 0, up, 0)
        child = alive & (up >= 0) & centre[owner]
        giver = np.full(n, -1, np.int64)
        giver[child] = up[child]  # a centroid's child hands its part to the centroid
        up = np.where(child | centre, -1, up)
        part = _tops(up)
        sums = np.zeros_like(values)
        np.add.at(sums, np.where(centre, here, np.where(giver[part] >= 0, giver[part], 0))[alive],
                  np.where((centre | (giver[part] >= 0))[:, None], values, 0)[alive])
        at = of_top[top[heavy]]
        totals[heavy] += sums[at]
        above = heavy & ~centre
        sub[above] -= sub[of_top[top[above]]]
        alive &= ~centre
    return totals


def _tops(up: np.ndarray) -> np.ndarray:
    top = np.where(up >= 0, up, np.arange(len(up)))
    while True:
        next_ = top[top]
        if (next_ == top).all():
            return top
        top = next_


def _split_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by component, in blocks of whole components."""

    def out(table: pa.Table) -> pa.RecordBatch:
        keys = table.column("key").to_pylist()
        place = {k: i for i, k in enumerate(keys)}
        parents = table.column("parent").to_pylist()
        comps = table.column("comp").to_pylist()
        parent = np.fromiter((-1 if k == c else place[p] for k, c, p in zip(keys, comps, parents)), np.int64, len(keys))
        values = np.stack([table.column(c).to_numpy() for c in ("leaf", "saved")], 1)
        found = split_block(parent, table.column("depth").to_numpy(), table.column("sub").to_numpy(), values)
        found += np.stack([table.column(c).to_numpy() for c in ("t_leaf", "t_saved")], 1)
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.binary()), pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())],
            names=["key", "n_leaves", "saved_tokens"],
        )

    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows < BLOCK:
            continue
        table = pa.Table.from_batches(held)
        last = table.column("comp")[rows - 1].as_py()
        cut = rows
        while cut and table.column("comp")[cut - 1].as_py() == last:  # at most PIECE steps
            cut -= 1
        if cut:
            yield out(table.slice(0, cut).combine_chunks())
        held, rows = table.slice(cut).combine_chunks().to_batches(), rows - cut
    if rows:
        yield out(pa.Table.from_batches(held).combine_chunks())


def subtree_sums(tree: DataFrame, paths: DataFrame, piece: int = PIECE) -> DataFrame:
    """``tree(key, parent, depth, conv, sub, leaf, saved)``, one tree, to (key, n_leaves, saved_tokens): sums over
    each node's subtree. ``paths(conv, p, key, parent)``: the node at each depth of a conversation; ``conv`` of a
    node is one that goes through it, ``sub`` the number of ``paths`` rows (and roots) at and below it."""
    zero = F.lit(0).cast("long")
    state = tree.withColumns({"t_leaf": zero, "t_saved": zero, "comp": _root()})
    small, done = [], []
    for _ in range(MAX_ROUNDS):
        sizes = keep(state.groupBy("comp").agg(F.count(F.lit(1)).alias("n"), F.max("sub").alias("rows")), "trie-sizes")
        sized = keep(left_join_by_key(state, sizes, "comp", "n"), "trie-sized")
        small.append(sized.filter(F.col("n") <= piece).select(tree.columns + ["t_leaf", "t_saved", "comp"]))
        large = sized.filter(F.col("n") > piece)
        heavy = 2 * F.col("sub") > F.col("rows")
        centres = large.filter(heavy).groupBy("comp").agg(F.max(F.struct("depth", "key")).alias("x"), F.max("n").alias("n"))
        centres = keep(centres.select("comp", "n", F.col("x.depth").alias("xd"), F.col("x.key").alias("xk")), "trie-centres")
        if centres.isEmpty():
            break
        told = left_join_by_key(large.drop("n"), centres, "comp", "n").withColumn("at", F.struct("comp", "conv"))
        told = keep(told, "trie-told")
        asked = told.filter("depth > xd").groupBy("at", "xk", "xd").agg(F.count(F.lit(1)).alias("k"))
        depths = [r[0] for r in centres.select("xd").distinct().limit(257).collect()]
        near = paths if len(depths) > 256 else paths.filter(F.col("p").isin([d + 1 for d in depths]))
        near = near.select(F.col("conv").alias("c"), "p", F.col("key").alias("child"), F.col("parent").alias("xk"))
        below = asked.join(near, (F.col("at.conv") == F.col("c")) & (F.col("p") == F.col("xd") + 1) & (asked.xk == near.xk))
        below = keep(below.select("at", "k", "child"), "trie-below")
        parted = left_join_by_key(told, below, "at", "k").drop("k", "at")
        parted = keep(parted.withColumn("child", F.when(F.col("depth") > F.col("xd"), F.col("child"))), "trie-parted")
        centre = F.col("key") == F.col("xk")
        sums = parted.filter(centre | F.col("child").isNotNull()).groupBy("comp").agg(
            F.sum("leaf").alias("s_leaf"), F.sum("saved").alias("s_saved"), F.max("sub").alias("s_sub")
        )
        sums = sums.join(centres.select("comp", "n"), "comp")
        path = left_join_by_key(parted.drop("n").filter(heavy), sums, "comp", "n")
        path = path.withColumns({"t_leaf": F.col("t_leaf") + F.col("s_leaf"), "t_saved": F.col("t_saved") + F.col("s_saved")})
        done.append(path.filter(centre).select("key", F.col("t_leaf").alias("n_leaves"), F.col("t_saved").alias("saved_tokens")))
        above = path.filter(~centre).withColumn("sub", F.col("sub") - F.col("s_sub"))
        rest = parted.filter(~heavy).withColumn("comp", F.coalesce("child", "comp"))
        columns = tree.columns + ["t_leaf", "t_saved", "comp"]
        state = keep(above.select(columns).unionByName(rest.select(columns)), "trie-state")
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    pieces = small[0]
    for more in small[1:]:
        pieces = pieces.unionByName(more)
    dealt = pieces.repartition(task_count(tree.sparkSession), "comp").sortWithinPartitions("comp")
    found = dealt.mapInArrow(_split_pieces, "key binary, n_leaves long, saved_tokens long")
    for more in done:
        found = found.unionByName(more)
    return found


# --- members that end at a node -----------------------------------------------------


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, conv) to a hash for each node, or to pieces of its list where others may follow elsewhere."""
    names = ["key", "first", "piece", "sha"]
    kinds = [pa.binary(), pa.int64(), pa.string(), pa.string()]
    key, ids, size, whole, begun = None, [], 0, False, False
    out = []

    def close(end: bool) -> None:
        text = ",".join(map(str, ids))
        if whole and not end:
            out.append((key, None, None, hashlib.sha256(text.encode()).hexdigest()))
        elif ids:
            out.append((key, ids[0], text, None))

    def flush() -> pa.RecordBatch:
        rows = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=names)
        out.clear()
        return rows

    for batch in batches:
        for k, conv in zip(batch.column("key").to_pylist(), batch.column("conv").to_pylist()):
            if k != key:
                if key is not None:
                    close(False)
                key, ids, size, whole, begun = k, [], 0, begun, True
            ids.append(conv)
            size += 20
            if size > LIST_BYTES:
                whole = False
                close(False)
                ids, size = [], 0
        if out:
            yield flush()
    if key is not None:
        close(True)
        if out:
            yield flush()


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, first, piece) to the hash of each node's whole list; one piece is held at a time."""
    key, digest = None, None
    for batch in batches:
        keys, found = [], []
        for k, piece in zip(batch.column("key").to_pylist(), batch.column("piece").to_pylist()):
            if k == key:
                digest.update(b"," + piece.encode())
                continue
            if key is not None:
                keys.append(key)
                found.append(digest.hexdigest())
            key, digest = k, hashlib.sha256(piece.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found, pa.string())], names=["key", "sha"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.hexdigest()])], names=["key", "sha"])


def member_hashes(ends: DataFrame) -> DataFrame:
    """``ends(key, conv)`` to (key, sha): SHA-256 of the node's conversations, ascending, joined by commas.

    Lists are written by range-partitioned tasks; only the pieces of a list that several tasks hold meet in one
    task, which hashes them one after the other (the hash allows no other way) and holds one at a time."""
    tasks = task_count(ends.sparkSession)
    ranged = ends.repartitionByRange(tasks, "key", "conv").sortWithinPartitions("key", "conv")
    found = keep(ranged.mapInArrow(_lists, "key binary, first long, piece string, sha string"), "trie-lists")
    pieces = found.filter("sha IS NULL").select("key", "first", "piece").repartition(tasks, "key")
    hashed = pieces.sortWithinPartitions("key", "first").mapInArrow(_hashes, "key binary, sha string")
    return found.filter("sha IS NOT NULL").select("key", "sha").unionByName(hashed)


# --- the operator -------------------------------------------------------------------


def prefix_trie(
    conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    piece: int = PIECE,
) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: conv_id (smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Conversation c begins with the first h turns of conversation c - c % 100 (h: CRC-32 of its decimal number,
    modulo 6), its own first h turns are left out. Null roles and texts are empty ones. Turns are ordered by
    turn, null first; equal turns by role, then text (in UTF-8); repeated rows are turns of their own. Rows without a
    conversation id belong to no conversation and are left out. A conversation left without turns is a member of
    the root. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    turns = conversations.select(
        F.col(id_col).cast("long").alias("conv"),
        F.col(turn_col).alias("turn"),
        whole_text(role_col).alias("role"),
        whole_text(text_col).alias("text"),
    ).filter("conv IS NOT NULL")
    info, rows = rebuilt_paths(turns)
    counted = rows.groupBy("k1", "k2", "p").agg(
        F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.max("chars").alias("chars"),
        F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.sum(F.col("n") - F.col("p") + 1).alias("sub"),
    )
    counted = counted.select(
        _key("k1", "k2").alias("key"), _key("p1", "p2").alias("parent"), F.col("p").alias("depth"), "conv", "n_convs", "chars", "sub"
    )
    root = info.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.sum(F.col("n") + 1).alias("sub"))
    root = root.filter("n_convs > 0").select(
        _root().alias("key"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), "conv", "n_convs",
        F.lit(0).cast("long").alias("chars"), "sub",
    )
    nodes = keep(counted.unionByName(root), "trie-nodes")
    children = nodes.groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children")).filter("key IS NOT NULL")
    nodes = keep(nodes.join(children, "key", "left").fillna(0, ["n_children"]), "trie-counted")
    tree = nodes.select(
        "key", "parent", "depth", "conv", "sub", (F.col("n_children") == 0).cast("long").alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"),
    )
    paths = rows.select("conv", "p", _key("k1", "k2").alias("key"), _key("p1", "p2").alias("parent"))
    ends = rows.filter("p = n").select(_key("k1", "k2").alias("key"), "conv")
    ends = ends.unionByName(info.filter("n = 0").select(_root().alias("key"), "conv"))
    parents = nodes.filter("n_children > 0").select(
        F.col("key").alias("parent"), F.col("conv").alias("parent_conv_id"), F.col("n_children").alias("under")
    )
    named = left_join_by_key(nodes, parents, "parent", "under")
    out = named.join(subtree_sums(tree, paths, piece), "key", "left").join(member_hashes(ends), "key", "left")
    return out.select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
