"""Texts rewritten by blocks: against plain Python, with repeated keys, small blocks and large tables."""

import random

import pytest

from plainspeak.operators import blocks, phrases, tfidf, vocabulary


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("budget", [None, 0])
def test_join_phrases_keeps_texts_whole(spark, monkeypatch, budget):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 64)
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randrange(12))) for _ in range(60)] + [None, "", "a  b\tc"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    linked = {("a", "b"), ("b", "c"), ("c", "c")}
    lexicon = spark.createDataFrame([(*p, 9) for p in linked], "a string, b string, n long")

    def joined(words):
        out, i = [], 0
        while i < len(words):
            pair = tuple(words[i : i + 2]) in linked
            out.append("_".join(words[i : i + 1 + pair]))
            i += 1 + pair
        return " ".join(out)

    found = phrases.join_phrases(docs, lexicon, "id", "t", budget)
    assert {r["id"]: r["t"] for r in found.collect()} == {i: joined((t or "").split()) for i, t in enumerate(texts)}
    assert "Window" not in plan(found) and "posexplode" not in plan(found)  # no row a word, sorted


def test_join_phrases_of_repeated_keys(spark):
    docs = spark.createDataFrame([(1, "x a b"), (1, "x a b"), (None, "a b")], "id long, t string")
    lexicon = spark.createDataFrame([("a", "b", 9)], "a string, b string, n long")
    got = {r["id"]: r["t"] for r in phrases.join_phrases(docs, lexicon, "id", "t").collect()}
    assert got == {1: "x x a_b b", None: "a_b"}


def test_ids_and_pooling_keep_texts_whole(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 64)
    docs = spark.createDataFrame([(1, "a b, zz a"), (2, None), (3, ""), (4, "c " * 40)], "id long, t string")
    words = spark.createDataFrame([("a", 9, 1), ("b", 5, 2), ("c", 2, 3)], "word string, n long, idx long")
    for budget in (None, 0):
        ids = vocabulary.ids_by_block(docs, words, "id", "t", budget=budget)
        assert {r["id"]: r["ids"] for r in ids.collect()} == {1: [1, 2, 1], 2: [], 3: [], 4: [3] * 40}
        assert "posexplode" not in plan(ids)
    matrix = spark.createDataFrame([(1, "a", [1.0, -4.0]), (2, "b", [4.0, -1.0])], "idx long, word string, vec array<float>")
    pooled = vocabulary.pool_vectors(docs, words, matrix, "id", "t", 2, limit=3)
    assert {r["id"]: tuple(r)[1:] for r in pooled.collect()} == {
        1: (3, [2.0, -3.0], [4.0, -1.0]), 2: (0, [0.0, 0.0], [0.0, 0.0]),
        3: (0, [0.0, 0.0], [0.0, 0.0]), 4: (40, [0.0, 0.0], [0.0, 0.0]),
    }
    assert "ObjectHashAggregate" not in plan(pooled)  # sorted a vector a word


def test_term_weights_keep_texts_whole(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 8)
    docs = spark.createDataFrame([(1, "A a\tb"), (2, ""), (3, " "), (4, None), (5, "a  b")], "id long, t string")
    found = tfidf.term_weights(docs, "id", "t")
    counts = {(r["id"], r["term"]): r["tf"] for r in found.collect()}
    assert counts == {(1, "a"): 2, (1, "b"): 1, (2, ""): 1, (5, "a"): 1, (5, ""): 1, (5, "b"): 1}
    assert "HashAggregate" not in plan(found)  # grouped a row a term of a text
