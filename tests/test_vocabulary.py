"""Vocabulary, encoding and pooling against brute force in Python."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plainspeak.operators.lookup import look_up, split_by_frequency
from plainspeak.operators.numbering import number_rows
from plainspeak.operators.vocabulary import (
    embedding_matrix, encode, fit_vocabulary, known_ids, pool_vectors, tokens,
)


def make_docs(count=60, seed=3):
    """Texts where one word makes up about a third of everything."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    docs = []
    for i in range(count):
        n = rng.choice([0, 1, 5, 30, 130])
        docs.append((i * 7 - 50, " ".join("hot" if rng.random() < 0.35 else rng.choice(words) for _ in range(n))))
    return docs


def brute_vocabulary(docs):
    counts = Counter()
    for _, text in sorted(docs):
        for w in text.split():
            counts[w] += 1
    order = sorted(counts, key=lambda w: -counts[w])  # stable: first appearance breaks ties
    return {w: (counts[w], i + 1) for i, w in enumerate(order)}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(make_docs(), "doc_id bigint, text string").repartition(3)


def test_fit(spark, docs):
    got = {r["word"]: (r["n"], r["idx"]) for r in fit_vocabulary(docs, "doc_id", "text").collect()}
    assert got == brute_vocabulary(make_docs())


def test_number_rows_has_no_gaps(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(7)
    got = number_rows(df, [F.desc("v")], "i", start=5).collect()
    assert sorted(r["i"] for r in got) == list(range(5, 1005))
    assert all(r["i"] == 999 - r["v"] + 5 for r in got)
    assert number_rows(df.filter("v < 0"), [F.asc("v")], "i").count() == 0


def brute_ids(docs, vocabulary):
    return {i: [vocabulary[w][1] for w in text.split() if w in vocabulary] for i, text in docs}


@pytest.mark.parametrize("budget, limit", [(None, None), (0, 5), (0, 1)])
def test_encode_on_each_tier(spark, docs, budget, limit):
    """The whole vocabulary broadcast, a part of it, and nearly nothing."""
    known = {w: v for w, v in brute_vocabulary(make_docs()).items() if w != "w3"}
    table = spark.createDataFrame([(w, n, i) for w, (n, i) in known.items()], "word string, n bigint, idx bigint")
    want = {k: ([0] * 100 + ids)[-100:] for k, ids in brute_ids(make_docs(), known).items()}
    got = encode(docs, table, "doc_id", "text", budget=budget, limit=limit)
    assert {r["doc_id"]: r["encoded"] for r in got.collect()} == want


def test_encode_fixture(spark):
    table = spark.createDataFrame(
        [("a", 9, 1), ("b", 8, 2)] + [(f"k{i}", 1, i) for i in range(3, 8)], "word string, n bigint, idx bigint"
    )
    df = spark.createDataFrame(
        [(1, "a b z a"), (2, "z z"), (3, ""), (4, "a b k3 k4 k5 k6 k7"), (5, None)], "id bigint, t string"
    )
    got = {r["id"]: r["encoded"] for r in encode(df, table, "id", "t", length=5).collect()}
    zero = [0] * 5
    assert got == {1: [0, 0, 1, 2, 1], 2: zero, 3: zero, 4: [3, 4, 5, 6, 7], 5: zero}


def test_frequent_part_is_bounded(spark):
    rows = [(f"w{i}", 1 + 1000 // (i + 1)) for i in range(500)] + [("x" * 100, 5000)]
    table = spark.createDataFrame(rows, "word string, n bigint")
    for limit in (1, 10, 100):
        frequent, rare = split_by_frequency(table, budget=0, limit=limit)
        words = {r["word"] for r in frequent.collect()}
        assert len(words) <= limit and "x" * 100 not in words
        assert frequent.count() + rare.count() == 501
    frequent, rare = split_by_frequency(table)
    assert rare is None and frequent.count() == 501


def test_hot_unknown_word_is_spread(spark):
    """A word missing from the table that is a third of the tokens goes to many tasks."""
    df = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, "missing").otherwise(F.concat(F.lit("w"), F.col("id") % 500)).alias("word")
    )
    table = spark.range(500).select(F.concat(F.lit("w"), "id").alias("word"), F.lit(1).alias("n"), F.col("id").alias("idx"))
    out = look_up(df, table, ["idx"], budget=0, limit=1, salt_from=["id"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    rows = out.collect()
    assert len(rows) == 3000
    assert all((r["idx"] is None) == (r["word"] == "missing") for r in rows)
    assert all(r["word"] == f"w{r['idx']}" for r in rows if r["idx"] is not None)


def test_embedding_matrix(spark):
    words = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4)], "word string, idx bigint")
    vectors = spark.createDataFrame(
        [("a", [1.0, 2.0]), ("c", [3.0, 4.0]), ("d", [5.0, 6.0]), ("q", [7.0, 8.0])], "word string, vec array<float>"
    )
    got = {r["idx"]: r["vec"] for r in embedding_matrix(words, vectors, 2, limit=4).collect()}
    assert got == {1: [1, 2], 2: [0, 0], 3: [3, 4], 4: [0, 0]}


def test_pooling(spark, docs):
    known = {w: v for w, v in brute_vocabulary(make_docs()).items() if w not in ("w3", "w5")}
    table = spark.createDataFrame([(w, n, i) for w, (n, i) in known.items()], "word string, n bigint, idx bigint")
    vec = {i: [((i * 37) % 11 - 5) / 4, ((i * 13) % 7 - 3) / 2] for _, i in known.values()}
    limit = 20
    matrix = spark.createDataFrame(
        [(i, v if i < limit else [0.0, 0.0]) for i, v in vec.items()], "idx bigint, vec array<float>"
    )
    got = {r["doc_id"]: r for r in pool_vectors(docs, table, matrix, "doc_id", "text", 2, limit=limit).collect()}
    for key, ids in brute_ids(make_docs(), known).items():
        vs = [vec[i] if i < limit else [0.0, 0.0] for i in ids] or [[0.0, 0.0]]
        assert got[key]["n_words"] == len(ids)
        assert got[key]["mean"] == pytest.approx([sum(c) / len(vs) for c in zip(*vs)], abs=1e-9)
        assert got[key]["max"] == [max(c) for c in zip(*vs)]


def test_known_ids_moves_lists_not_words(spark, docs):
    table = fit_vocabulary(docs, "doc_id", "text")
    plan = known_ids(docs, table, "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "partial_collect_list" in plan and "Python" not in plan


def test_tokens_keep_empty(spark):
    df = spark.createDataFrame([(1, "a b"), (2, ""), (3, "..")], "id int, t string")
    assert tokens(df, "id", "t").count() == 2
    assert tokens(df, "id", "t", keep_empty=True).count() == 4


def test_only_unresolved_tokens_are_shuffled(spark):
    """9,500 of 10,000 tokens are one word of the broadcast part: they don't take part in the second join."""
    tokens = spark.range(10_000).select(
        "id", F.when(F.col("id") % 20 > 0, "often").otherwise(F.concat(F.lit("w"), "id")).alias("word")
    )
    words = spark.createDataFrame([("often", 9_500, 1)] + [(f"w{i}", 1, 2) for i in range(0, 5_000, 20)], "word string, n long, v int")
    found = look_up(tokens, words, ["v"], budget=0, limit=1000)
    assert found.count() == 10_000
    counts = {r["v"]: r["count"] for r in found.groupBy("v").count().collect()}
    assert counts == {1: 9_500, 2: 250, None: 250}
    plan = found._jdf.queryExecution().executedPlan()
    found.collect()
    written = [
        node.metrics().apply("shuffleRecordsWritten").value()
        for node in _nodes(plan)
        if node.nodeName() == "Exchange"
    ]
    # 500 tokens without an entry in the broadcast part, and the 250 rare words once for each of 8 salts.
    assert written and 0 < sum(written) <= 500 + 250 * 8


def _nodes(plan):
    out, todo = [], [plan]
    while todo:
        node = todo.pop()
        out.append(node)
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return out


@pytest.mark.parametrize("budget", [0, 10**9])
def test_look_up_without_counts(spark, budget):
    tokens = spark.createDataFrame([("a",), ("b",), (None,), ("a",)], "word string")
    for counts in ([("a", None, 1), ("b", 5, 2)], [("a", 0, 1), ("b", 0, 2)]):
        words = spark.createDataFrame(counts, "word string, n long, v int")
        got = look_up(tokens, words, ["v"], budget=budget).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, [("a", 1), ("b", 2), (None, None), ("a", 1)]))


def test_matrix_of_all_words_with_repeated_vectors_and_padding(spark):
    words = spark.createDataFrame([("a", 3, 1), ("b", 2, 2), ("c", 1, 20_000)], "word string, n long, idx long")
    vectors = spark.createDataFrame([("a", [1.0]), ("a", [2.0]), ("c", [5.0]), ("x", [9.0])], "word string, vec array<float>")
    got = {r["idx"]: (r["word"], r["vec"]) for r in embedding_matrix(words, vectors, 1, limit=None, padding=True).collect()}
    assert got == {0: (None, [0.0]), 1: ("a", [2.0]), 2: ("b", [0.0]), 20_000: ("c", [5.0])}
    assert {r["idx"]: r["vec"] for r in embedding_matrix(words, vectors, 1).collect()} == {1: [2.0], 2: [0.0], 20_000: [0.0]}
