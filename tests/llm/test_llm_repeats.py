import hashlib
import random
import re

import pytest

import llm_cases
from plainspeak.llm import repeats as R


def brute(rows):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen, out = set(), []
    gone = {i: set() for i in order}
    for i in order:
        for s in range(len(words[i]) - 19):
            w = tuple(words[i][s : s + 20])
            if w in seen:
                gone[i].update(range(s, s + 20))
            seen.add(w)
    for i in order:
        kept = " ".join(w for k, w in enumerate(words[i]) if k not in gone[i])
        out.append((rows[i][0], len(words[i]), len(gone[i]), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def make(seed, n=60):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "Ä", "日本", "x" * 300, *map(str, range(60))]
    passages = [[rng.choice(vocabulary) for _ in range(k)] for k in (19, 20, 21, 45, 130, 400)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(rng.randrange(6)):
            p = rng.choice(passages)
            a, b = sorted((rng.randrange(len(p) + 1), rng.randrange(len(p) + 1)))
            w += (p if rng.random() < 0.5 else p[a:b]) + [rng.choice(vocabulary) for _ in range(rng.randrange(30))]
        rows.append((i, "".join(x + rng.choice([" ", "  ", "\n", "\t\x0b"]) for x in w)))
    rows += [(900, "same " * 200), (901, "same " * 30), (902, "p q r " * 40), (903, None), (904, " \n"), (None, rows[3][1]), (None, "p q r " * 9)]
    rows += [(905, " ".join(passages[5])), (905, " ".join(passages[5][100:])), rows[5], (950, rows[5][1])]
    rng.shuffle(rows)
    return rows


def found(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)  # one partition: read in this order
    return sorted((tuple(r) for r in R.remove_repeats(frame).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, seed):
    rows = make(seed)
    assert found(spark, rows) == brute(rows)


def test_chunks_hold_every_window_once(monkeypatch):
    rng = random.Random(3)
    words = [rng.choice(["a", "bb", "c" * 40]) + str(i) for i in range(700)]
    joined = " ".join(words).encode()
    for size in (64, 500, 10_000):
        monkeypatch.setattr(R, "BLOCK", size)
        starts = []
        for piece, first in R._chunks(joined):
            mine = piece.decode().split(" ")
            assert mine == words[first : first + len(mine)]
            starts += range(first, first + len(mine) - 19)
        assert starts == list(range(681))


def test_odd_rows(spark):
    rows = [(r[0], r[1]) for r in llm_cases.ROWS]
    got = sorted((tuple(r) for r in R.remove_repeats(llm_cases.rows(spark).coalesce(1)).collect()), key=str)
    assert got == brute(rows)
    assert R.remove_repeats(llm_cases.none(spark)).count() == 0
