import random
import re
from collections import Counter

import pytest

import llm_cases
from plainspeak.llm import collocations as C

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            n[lang] += len(words)
            for size in (1, 2, 3):
                f.update((lang, tuple(words[i : i + size])) for i in range(len(words) - size + 1))
    kept = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    around = Counter()
    for (lang, w), a in kept.items():
        for part in {w[:2], w[1:]} if len(w) == 3 else ():
            around[lang, part] = max(around[lang, part], a)
    out = {}
    for (lang, w), a in kept.items():
        if len(w) == 2 and 100 * around[lang, w] >= 50 * a:
            continue
        score, _, l, r = min((10**6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return {
        (lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, x in out.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:top], 1)
    }


def make(seed, n=150):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "new", "york", "city", "ÄB", "äb", "日本", "a" * 300, "x\x00y", "𝒳"]
    join = [" ", "  ", "\t", ", ", ".", "\n", "\r\n", " \x0b", " "]
    texts = []
    for _ in range(n):
        w = [rng.choice(vocabulary) if rng.random() < 0.8 else str(rng.randrange(30)) for _ in range(rng.randrange(40))]
        texts.append("".join(x + rng.choice(join) for x in w))
    rows = [(rng.choice(["en", "en", "de", "", None]), t) for t in texts]
    return rows + [("en", None), ("fr", ""), (None, " .,\n"), ("en", "new york city " * 50)] + rows[:20]


def found(spark, rows, **options):
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string")
    got = [tuple(r) for r in C.collocations(frame, **options).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("seed, least, top, sample", [(1, 10, 2_000, 16), (2, 3, 25, 1), (3, 2, 2_000, 1_000)])
def test_brute_force(spark, seed, least, top, sample):
    rows = make(seed)
    assert found(spark, rows, least=least, top=top, sample=sample) == brute(rows, least, top)


def test_long_text_is_counted_across_cuts(spark, monkeypatch):
    rng = random.Random(4)
    text = "".join(rng.choice(["one", "two", "three", "Four"]) + rng.choice([" ", " ", "\t ", ". ", "\n"]) for _ in range(3_000))
    want = Counter()
    for piece in re.split(r"[.\n]", text.translate(LOWER)):
        w = piece.split()
        for size in (1, 2, 3):
            want.update((size, " ".join(w[i : i + size])) for i in range(len(w) - size + 1))
    monkeypatch.setattr(C, "BLOCK", 97)
    got = Counter()
    for _, block in C._cut("en", text.encode().translate(C._FOLD)):
        every = [True] * len(block.near)
        for size, (texts, counts) in (
            (1, block.words()), (2, block.pairs(C.np.array(every, bool))), (3, block.triples(C.np.array(every[1:], bool)))
        ):
            for t, k in zip(texts.to_pylist(), counts):
                got[size, t] += int(k)
    assert got == want


def test_odd_rows(spark):
    rows = [(r[2], r[1]) for r in llm_cases.ROWS]
    got = {tuple(r) for r in C.collocations(llm_cases.rows(spark), least=2).collect()}
    assert got == brute(rows, 2, 2_000)
    assert C.collocations(llm_cases.none(spark)).count() == 0


def test_scores_beyond_64_bits(spark):
    at = spark.range(1).selectExpr("3000000000000L a", "3000000000001L l", "3000000000000L r")
    score = at.selectExpr(
        "(1000000BD * CAST(a AS DECIMAL(16,0)) * CAST(a AS DECIMAL(16,0))) div (CAST(l AS DECIMAL(18,0)) * CAST(r AS DECIMAL(18,0))) s"
    )
    assert score.first()["s"] == 10**6 * 3000000000000**2 // (3000000000001 * 3000000000000)
