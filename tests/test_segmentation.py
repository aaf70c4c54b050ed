"""Compound words of any length: expectation steps and the Viterbi pass against plain enumeration."""

import math
import os
import random
from collections import Counter

import pytest

from plainspeak.operators import segmentation as S

FOLDER = "/root/testdata/sf0.001"


def divisions(syllables, longest):
    if not syllables:
        yield []
    for n in range(1, min(longest, len(syllables)) + 1):
        for rest in divisions(syllables[n:], longest):
            yield ["_".join(syllables[:n]), *rest]


def cost(words, model):
    total = 0
    for w in words:
        if w not in model.costs and "_" in w:
            return None
        total += model.costs.get(w, model.unknown)
    return total


def some_model(rng, longest=3):
    words = ["_".join(rng.choice("abcd") for _ in range(rng.randint(1, longest))) for _ in range(25)]
    return S.WordModel.of_counts({w: rng.randint(1, 9) for w in words}, longest)


def test_cheapest_division():
    rng = random.Random(1)
    for _ in range(150):
        model = some_model(rng)
        syllables = [rng.choice("abcde") for _ in range(rng.randrange(9))]
        found = S.segment(syllables, model)
        assert "_".join(found) == "_".join(syllables)
        costs = [(cost(d, model), len(d)) for d in divisions(syllables, 3)]
        assert (cost(found, model), len(found)) == min(c for c in costs if c[0] is not None)


def test_expected_counts():
    rng = random.Random(2)
    for _ in range(60):
        model = some_model(rng)
        syllables = [rng.choice("abcde") for _ in range(rng.randrange(1, 8))]
        want, total = Counter(), 0.0
        for d in divisions(syllables, 3):
            c = cost(d, model)
            if c is not None:
                p = math.exp(-c / S.MICRO)
                total += p
                for w in d:
                    want[w] += p
        got = {}
        S.expected_counts(syllables, model, got)
        assert set(got) == set(want)
        assert all(math.isclose(got[w], want[w] / total, rel_tol=1e-9) for w in want)


def test_long_text_keeps_its_mass():
    model = S.WordModel.of_counts({"a": 1, "b": 1, "a_b": 5}, 2)
    got = {}
    S.expected_counts(["a", "b"] * 20_000, model, got)
    assert math.isclose(got["a"] + got["a_b"], 20_000, rel_tol=1e-6)


def plain_fit(texts, longest, least, rounds):
    lists, runs = [t.split() for t in texts], Counter()
    for w in lists:
        for n in range(1, longest + 1):
            runs.update(("_".join(w[i : i + n]), n) for i in range(len(w) - n + 1))
    sizes = {w: n for (w, n), k in runs.items() if k >= least or n == 1}
    counts = {w: k for (w, n), k in runs.items() if w in sizes}
    total = sum(k for w, k in counts.items() if sizes[w] == 1)

    def holds(w):
        x = w.split("_")
        return sizes[w] == 1 or all(
            counts[w] * total > S.RATIO * counts["_".join(x[:i])] * counts["_".join(x[i:])] for i in range(1, len(x))
        )

    model = S.WordModel.of_counts({w: float(k) for w, k in counts.items() if holds(w)}, longest)
    for _ in range(rounds):
        sums = Counter()
        for w in lists:
            mine = {}
            S.expected_counts(w, model, mine)
            sums.update({k: round(x * S.MICRO) for k, x in mine.items()})
        model = S.WordModel.of_counts({w: n / S.MICRO for w, n in sums.items() if n / S.MICRO >= least or sizes[w] == 1}, longest)
    return model


def test_compounds_are_learned(spark):
    rng = random.Random(3)
    words = ["thành_phố_hồ_chí", "học_sinh", "xin", "rất", "cộng_hòa_xã"]
    texts = [" ".join(rng.choice(words).replace("_", " ") for _ in range(12)) for _ in range(80)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(100, None), (101, ""), (101, "xin")], "id long, t string")
    model = S.fit_words(docs, "t")
    got = {r["t"] for r in S.segment_texts(docs.filter("id < 80"), model, "id", "t").collect()}
    assert {w for t in got for w in t.split()} == set(words)
    rest = S.segment_texts(docs.filter("id >= 100"), model, "id", "t").collect()
    assert sorted((r["id"], r["t"]) for r in rest) == [(100, ""), (101, ""), (101, "xin")]
    empty = docs.filter("id < 0")
    assert S.segment_texts(empty, S.fit_words(empty, "t"), "id", "t").count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_all_documents_against_plain_python(spark):
    from checks import tables
    from checks.registry import QUERIES

    got = {r["doc_id"]: r["text_clean"] for r in QUERIES["segment_words"](spark, FOLDER).collect()}
    texts = {r["doc_id"]: r["text_clean"] for r in tables.corpus(spark, FOLDER).collect()}
    model = plain_fit(texts.values(), S.LONGEST, S.LEAST, S.ROUNDS)
    assert got == {k: " ".join(S.segment(t.split(), model)) for k, t in texts.items()}


def test_driver_gets_at_most_the_words_of_the_model(spark, monkeypatch):
    kind, got = type(spark.range(1)), []
    for name in ("collect", "toArrow"):
        plain = getattr(kind, name)

        def counted(self, plain=plain):
            found = plain(self)
            got.append(len(found))
            return found

        monkeypatch.setattr(kind, name, counted)
    docs = spark.createDataFrame([(i, f"rare{i} a b") for i in range(200)], "id long, t string")
    model = S.fit_words(docs, "t", most=3)
    assert set(model.costs) == {"a", "b"}  # the run of both is no likelier than chance
    assert max(n for n in got if n) <= 8  # of the model's words, or task sizes; never the 202 syllables
