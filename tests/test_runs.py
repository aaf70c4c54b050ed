"""Frequent runs of words without a row a run, and divisions of many numbered texts at once, against plain Python."""

import random
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from plainspeak.operators import divisions, runs
from plainspeak.operators import segmentation as S


def some_texts(rng, words, number, most):
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(most))) for _ in range(number)]


def plain_runs(texts, longest, least, most):
    found = Counter()
    for t in texts:
        w = (t or "").split()
        for n in range(1, longest + 1):
            found.update(("_".join(w[i : i + n]), n) for i in range(len(w) - n + 1))
    rows = [(w, size, n) for (w, size), n in found.items() if n >= least or size == 1]
    return sorted(rows, key=lambda r: (-r[2], r[1], r[0].encode()))[:most]


@pytest.mark.parametrize("most", [1, 7, 40, 100_000])
@pytest.mark.parametrize("words", ["a b c dd é", "a b a_b b_a _ a_b_a __ c"])
def test_most_frequent_runs(spark, words, most):
    texts = [*some_texts(random.Random(5), words.split(), 60, 12), None, "", "  ", "x y a"]
    docs = spark.createDataFrame([(t,) for t in texts], "t string").repartition(3)
    found, numbered, _ = runs.frequent_runs(docs, "t", 4, 3, most)
    rows = list(zip(*[found[c].to_pylist() for c in ("word", "size", "n")]))
    assert rows == plain_runs(texts, 4, 3, most)
    assert numbered.count() == len(texts)


def rows_of(table):
    return [table.slice(i, 1) for i in range(len(table))]


@pytest.mark.parametrize("bits,held", [(3, 1 << 20), (20, 1 << 20), (20, 40)])
def test_crowded_slots_and_full_tasks_lose_no_run(monkeypatch, bits, held):
    monkeypatch.setattr(runs, "HELD", held)
    monkeypatch.setattr(runs, "NUMBER_BYTES", 400)
    rng, need, parts, base = random.Random(6), 4, 3, 31
    texts = [[rng.randrange(1, 31) if rng.random() < 0.9 else 0 for _ in range(rng.randrange(40))] for _ in range(60)]
    blobs = [np.array([*t, runs.END], np.int32).tobytes() for t in texts]
    batches = [pa.record_batch({"numbers": pa.array(blobs[i : i + 20], pa.binary())}) for i in range(0, 60, 20)]
    want = Counter(p for t in texts for p in zip(t, t[1:]) if all(p))
    shared = SimpleNamespace(value=(base, []))
    sent = pa.Table.from_batches([b for x in batches for b in runs._sketched(shared, bits, need, parts)([x])])
    often = np.zeros(1 << bits, bool)
    for part, (i, j) in enumerate(runs._slots_of(bits, parts)):
        found = runs._often(bits, need, parts)(sent.filter(pa.compute.equal(sent["part"], part)))
        often[i:j] = np.unpackbits(np.frombuffer(found["often"][0].as_py(), np.uint8), count=j - i)
    assert all(often[runs.mixed(np.array([a * base + b]), bits)[0]] for (a, b), n in want.items() if n >= need)
    shared = SimpleNamespace(value=(base, [], np.packbits(often).tobytes()))
    sent = pa.Table.from_batches([b for x in batches for b in runs._counted(shared, bits, parts)([x])])
    names = pa.array(["", *map(str, range(1, 31))])
    named, got = SimpleNamespace(value=(base, names, names)), {}
    for part in range(parts):
        mine = sent.filter(pa.compute.equal(sent["part"], part))
        if len(mine):
            found = runs._enough(named, need)(mine)
            got.update(zip(found["word"].to_pylist(), found["n"].to_pylist()))
    assert got == {f"{a}_{b}": n for (a, b), n in want.items() if n >= need}
    if bits == 20 and held > 40:  # rare runs don't leave their task
        assert sum(sent["size"].to_pylist()) <= 3 * len(got)


def test_no_row_a_run_is_grouped(spark, monkeypatch):
    rng = random.Random(7)
    texts = some_texts(rng, [f"w{i}" for i in range(400)], 150, 120)
    docs = spark.createDataFrame([(t,) for t in texts], "t string").repartition(2)
    kind, sizes = type(docs), []
    plain = kind.groupBy

    def watched(self, *columns):
        sizes.append(self.count())
        return plain(self, *columns)

    monkeypatch.setattr(kind, "groupBy", watched)
    S.fit_words(docs, "t", rounds=1)
    assert sizes and max(sizes) <= 2_000  # of 9,000 words and 36,000 runs


def some_model(rng, syllables):
    words = {"_".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(30)}
    return S.WordModel.of_counts({w: rng.randint(1, 9) for w in words}, 4)


@pytest.mark.parametrize("few", [1, 8, 1000])
def test_many_texts_at_once(monkeypatch, few):
    """Alone or side by side, each text gets what ``expected_counts`` and ``segment`` give."""
    monkeypatch.setattr(divisions, "FEW", few)
    rng = random.Random(8)
    for turn in range(25):
        model = some_model(rng, "abc")
        texts = [t.split() for t in some_texts(rng, list("abcx"), 40, 25)] + [list("ab" * 100)] * (turn % 2)
        listed = {w: k for k, w in enumerate(sorted({*model.costs, "a", "b"}))}
        vocabulary = runs.simple_parts([*listed, "a_b"])
        numbered = divisions.NumberedModel.of(model, vocabulary, listed)
        flat = pa.array([w for t in texts for w in t], pa.string())
        rows = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        numbers, odd = runs.numbered_words(flat, rows, len(texts), pa.array(vocabulary, pa.string()))
        assert not odd.any()
        want = [0] * len(listed)
        for t in texts:
            mine = {}
            S.expected_counts(t, model, mine)
            for w, x in mine.items():
                if w in listed:
                    want[listed[w]] += round(x * S.MICRO)
        got = divisions.expected(numbers, numbered, S._chances(numbered), len(listed), S.MICRO)
        assert np.abs(got - np.array(want)).max() <= 1  # micro-counts
        joined = divisions.glued(numbers, numbered)[numbers != runs.END]
        assert S._written(flat, rows, len(texts), joined).to_pylist() == [" ".join(S.segment(t, model)) for t in texts]


def test_what_is_beside_a_text_does_not_change_its_counts(monkeypatch):
    rng = random.Random(9)
    model = some_model(rng, "ab")
    listed = {w: k for k, w in enumerate(model.costs)}
    vocabulary = runs.simple_parts(list(listed))
    numbered = divisions.NumberedModel.of(model, vocabulary, listed)
    texts = [np.array([*(rng.randrange(len(vocabulary) + 1) for _ in range(rng.randrange(60))), runs.END], np.int32) for _ in range(50)]
    chances = S._chances(numbered)
    one = [divisions.expected(t, numbered, chances, len(listed), S.MICRO) for t in texts]
    assert np.array_equal(sum(one), divisions.expected(np.concatenate(texts), numbered, chances, len(listed), S.MICRO))


def test_syllables_that_look_like_words_of_several(spark):
    rng = random.Random(10)
    texts = some_texts(rng, ["a b", "a_b", "c", "b_c", "a", "_", "a b c", "d"], 60, 9)
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    model = S.fit_words(docs, "t", least=2)
    assert any("_" in w for w in model.costs)
    got = {r["id"]: r["t"] for r in S.segment_texts(docs, model, "id", "t").collect()}
    assert got == {k: " ".join(S.segment(t.split(), model)) for k, t in enumerate(texts)}
