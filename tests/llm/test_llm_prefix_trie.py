import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from plainspeak.llm.prefix_trie import prefix_trie, split_block

SCHEMA = "conv_id long, turn int, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        built[c] = own.get(base, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
        mine = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        saved[node] = mine + sum(saved[k] for k in children[node])
    out = set()
    for node, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(node))))
        up = min(members[node[:-1]]) if node else None
        out.add((min(m), len(node), up, len(m), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def found(spark, rows, piece=4_096, schema=SCHEMA):
    got = [tuple(r) for r in prefix_trie(spark.createDataFrame(rows, schema), piece=piece).collect()]
    assert len(got) == len(set(got))
    return set(got)


def make(seed, n=60, long_=0):
    rng = random.Random(seed)
    rows = []
    for c in [0, 100, 200, *rng.sample(range(-150, 400), n)]:
        for turn in range(rng.choice([0, 1, 2, 3, 7])):
            rows.append((c, rng.choice([turn, turn, None, 3]), rng.choice(["u", "a", None]), rng.choice(["", "x", "yy", "𝒳ä", None])))
    rows += [(c, t, "u", "same") for c in range(700, 760) for t in range(6)]
    rows += [(907, t, "u", f"{t % 3}") for t in range(long_)]
    rows += [(None, 1, "u", "nobody"), (5, 0, "u", "x"), (5, 0, "u", "x")]
    rng.shuffle(rows)
    return list(dict.fromkeys(rows)) + rows[:5]


@pytest.mark.parametrize("seed, piece, long_", [(1, 4_096, 0), (2, 20, 90)])
def test_brute_force(spark, seed, piece, long_):
    rows = make(seed, long_=long_)
    assert found(spark, rows, piece) == brute(rows)


def test_empty_table(spark):
    assert found(spark, []) == set()


def test_turnless_conversations_stay_at_the_root(spark):
    short = [c for c in range(101, 160) if zlib.crc32(str(c).encode()) % 6 >= 2][:3]
    rows = [(c, 0, "u", "hello") for c in short]
    assert found(spark, rows) == brute(rows)
    assert {r[1] for r in found(spark, rows)} == {0}


def test_clashing_columns(spark):
    names = "key string, conv string, n long, task int, p long, nth long, sub long, comp string, d1 long"
    rows = make(3, n=10)
    wide = [(*r, "k", "c", 1, 2, 3, 4, 5, "x", 6) for r in rows]
    assert found(spark, wide, schema=f"{SCHEMA}, {names}") == brute(rows)


def test_split_block_on_chains_stars_and_random_trees():
    rng = np.random.default_rng(5)
    for shape in ("chain", "star", "random"):
        n = 500
        parent = {"chain": np.arange(n) - 1, "star": np.zeros(n, np.int64)}.get(shape)
        if parent is None:
            parent = np.array([-1, *[rng.integers(0, i) for i in range(1, n)]])
        parent = parent.copy()
        parent[0] = -1
        depth, weight = np.zeros(n, np.int64), rng.integers(1, 50, n)
        values = rng.integers(0, 9, (n, 2))
        want, sub = values.copy(), weight.copy()
        for i in range(1, n):
            depth[i] = depth[parent[i]] + 1
        for i in range(n - 1, 0, -1):
            want[parent[i]] += want[i]
            sub[parent[i]] += sub[i]
        assert (split_block(parent, depth, sub, values) == want).all()
