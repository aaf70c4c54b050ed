import random

import llm_cases
import numpy as np
import pytest
import xxhash

from plainspeak.llm import simhash
from plainspeak.llm.components import components


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(pairs, budget=4):
    """Smallest id reachable, by comparing everything."""
    fps = sorted({fp for _, fp in pairs})
    label = list(range(len(fps)))
    for _ in fps:
        before = list(label)
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= budget and label[j] < label[i]:
                    label[i] = label[j]
        if label == before:
            break
    root = dict(zip(fps, label))
    least = {}
    for i, fp in pairs:
        if i is not None:
            least[root[fp]] = min(i, least.get(root[fp], i))
    return [(i, fp, least.get(root[fp])) for i, fp in pairs]


@pytest.mark.parametrize("text", ["", " \n", "One", "a b c", "a b c d", "Ä b C d e　f g", "x y " * 30_000, "A a A a A"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_against_brute_force(spark):
    found = simhash.near_duplicates(llm_cases.rows(spark)).collect()
    pairs = [(r[0], brute_fingerprint(r[1])) for r in llm_cases.ROWS]
    want = [(i, f"{fp:016x}", c) for i, fp, c in brute_components(pairs)]
    assert sorted([tuple(r) for r in found], key=str) == sorted(want, key=str)


def neighbours(n, seed):
    """Chains and balls of close numbers between far ones, and pairs that differ in one run of bits only."""
    r = random.Random(seed)
    out = {0, 2**64 - 1}
    while len(out) < n:
        x = r.getrandbits(64)
        out.add(x)
        for _ in range(r.choice([0, 1, 5, 20])):
            for _ in range(r.randint(1, 5)):
                x ^= 1 << r.choice([r.randrange(64), r.randrange(4), 60 + r.randrange(4)])
            out.add(x)
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_links_have_the_components_of_all_pairs(spark, seed):
    fps = neighbours(700, seed)
    signed = [(int(np.uint64(x).astype(np.int64)),) for x in fps]
    edges = simhash.links(spark.createDataFrame(signed, "fp long")).collect()
    label = {s[0]: s[0] for s in signed}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in edges:
        assert (np.uint64(np.int64(a)) ^ np.uint64(np.int64(b))).item() != 0
        label[max(top(a), top(b))] = min(top(a), top(b))
    got = {}
    for x, s in zip(fps, signed):
        got.setdefault(top(s[0]), set()).add(x)
    want = {}
    for i, fp, c in brute_components(list(enumerate(fps))):
        want.setdefault(c, set()).add(fp)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_a_dense_group_gives_no_pairs():
    r = np.random.default_rng(3)
    centre = np.uint64(0x0123456789ABCDEF)
    fps = np.unique(centre ^ (np.uint64(1) << r.integers(0, 64, 4000).astype(np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 4000).astype(np.uint64)))
    n = len(fps)
    a, b = simhash._join_block(np.zeros(n, np.int8), np.zeros(n, np.int32), fps, np.zeros(n, bool), 4)
    assert len(a) == n - 1 and len(np.unique(np.concatenate([a, b]))) == n


def test_one_of_each_group_stays(spark):
    docs = llm_cases.rows(spark)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert {1, 4, 7, 9, 10, None} <= ids and not ids & {2, 3, 5, 6, 8}


def test_empty_table(spark):
    assert simhash.near_duplicates(llm_cases.none(spark)).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    found = components(spark.createDataFrame(path + star + [(5, 5), (7, None)], "a long, b long")).collect()
    roots = {r["node"]: r["root"] for r in found}
    assert len(found) == len(roots) == 201 + 300
    assert all(root == (0 if node <= 200 else 1000) for node, root in roots.items())
