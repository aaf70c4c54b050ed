"""Vocabulary and numbers of texts handled as Arrow columns; model queries that clean and pool their rows once."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from checks import registry
from plainspeak.operators import blocks, counts, vocabulary
from plainspeak.plans import training


def texts(seed, count=60):
    rng = random.Random(seed)
    return [rng.choice(["", " "]).join(rng.choice(["aa ", "b,", "C-d ", "é\t", "''e ", "f\xa0g "]) for _ in range(rng.randrange(9))) for _ in range(count)]


def words(text):
    for c in '!"#$%&()*+,-./:;<=>?@[\\]^`{|}~\t\n':
        text = (text or "").replace(c, " ")
    return [w for w in text.split(" ") if w]


def ranked(rows):
    n, first = Counter(), {}
    for key, text in rows:
        for pos, w in enumerate(words(text)):
            n[w] += 1
            if key is not None:
                first[w] = min(first.get(w, (key, pos)), (key, pos))
    return n, first


def test_fit_vocabulary_counts_whole_texts(spark, monkeypatch):
    rows = [(i % 50 - 20, t) for i, t in enumerate(texts(5))] + [(3, None), (None, "aa only"), (None, "")]
    docs = spark.createDataFrame(rows, "id long, t string")
    n, first = ranked(rows)
    got = {r["word"]: (r["n"], r["idx"]) for r in vocabulary.fit_vocabulary(docs, "id", "t").collect()}
    order = sorted(n, key=lambda w: (-n[w], w in first, first.get(w)))  # no key comes first
    assert got == {w: (n[w], i) for i, w in enumerate(order, 1)}
    assert vocabulary.fit_vocabulary(docs.limit(0), "id", "t").count() == 0

    monkeypatch.setattr(vocabulary, "number_rows", lambda found, *_: found.withColumnRenamed("first_place", "idx"))
    plan = vocabulary.fit_vocabulary(docs, "id", "t")._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" not in plan


@pytest.mark.parametrize("size", [1, 30, 1 << 20])
def test_first_places_do_not_depend_on_chunks(monkeypatch, size):
    monkeypatch.setattr(counts, "CHUNK_BYTES", size)
    rows = [(None if i % 9 == 4 else (i * 7) % 40, t) for i, t in enumerate(texts(6))]
    lines = [" ".join(words(t)) or None for _, t in rows]
    table = pa.table({"key": pa.array([k for k, _ in rows], pa.int64()), "line": pa.array(lines, pa.string())})
    n, first = Counter(), {}
    for r in pa.Table.from_batches(list(vocabulary._first_seen(iter(table.to_batches(max_chunksize=17))))).to_pylist():
        n[r["word"]] += r["n"]
        if r["key"] is not None:
            first[r["word"]] = min(first.get(r["word"], (r["key"], r["pos"])), (r["key"], r["pos"]))
    assert (n, first) == ranked(rows)


def test_numbers_of_repeated_and_missing_keys():
    block = pa.table({"block": [0] * 5, "key": pa.array([4, None, 4, 2, None], pa.int64()), "line": [" a b c", " b x", " c a", "", " a"]})
    asked = blocks._distinct_words(block)
    assert sorted(asked["term"].to_pylist()) == ["a", "b", "c", "x"] and asked["block"].to_pylist() == [0] * 4
    known = pa.table({"term": ["c", "a", "b"], "value": pa.array([1, 2, 3], pa.int32())})
    found = {r["key"]: r["out"] for r in blocks._numbered(block, known).to_pylist()}
    assert found == {4: [1, 2, 2, 3, 1], None: [2, 3], 2: []}
    assert blocks._numbered(block, known.slice(0, 0))["out"].to_pylist() == [[], [], []]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at, rng = str(tmp_path_factory.mktemp("tables")), np.random.default_rng(1)
    docs = [(i, " ".join(rng.choice(["one", "two", "three", "four"], 6))) for i in range(40)]
    made = {
        "documents": spark.createDataFrame(docs, "doc_id long, text string"),
        "labels": spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(40)], "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(0, "five six"), (1, "one two")], "item_id long, text string"),
        "embeddings": spark.createDataFrame([(i, [float(i)] * 64) for i in range(8)], "vec_id long, embedding array<float>"),
    }
    for name, rows in made.items():
        rows.write.parquet(f"{at}/{name}.parquet")
    return at


class Seen(Exception):
    pass


@pytest.mark.parametrize("name, fit, parts", [("model_mlp", "_judged_model", "01234567 8 9"), ("model_epochs", "fit_epochs", "01234567 8")])
def test_model_queries_clean_and_pool_once(spark, folder, monkeypatch, name, fit, parts):
    calls = Counter()

    def counting(owner, attribute):
        own = getattr(owner, attribute)

        def run(*args, **options):
            calls[attribute] += 1
            return own(*args, **options)

        monkeypatch.setattr(owner, attribute, run)

    def stop(*args, **_):
        raise Seen([x for x in args if hasattr(x, "columns")])

    counting(registry.t, "labelled_corpus")
    counting(training.VectorFeatures, "transform")
    monkeypatch.setattr(registry, fit, stop)
    with pytest.raises(Seen) as seen:
        registry.QUERIES[name](spark, folder)
    assert calls == {"labelled_corpus": 1, "transform": 1}
    rows = [r for x in seen.value.args[0] for r in x.collect()]
    assert sorted({r["doc_id"] % 10 for r in rows}) == [int(c) for c in parts if c != " "]
    assert len({r["doc_id"] for r in rows}) == len(rows) and all(len(r["pooled"]) == 128 for r in rows)
