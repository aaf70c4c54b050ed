"""Phrases, weights, stop words, pages, ids, panels, metrics: small fixtures, brute force."""

import math
import random
from collections import Counter

import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from plainspeak.operators import frames, ids, metrics, pages, panels, phrases, splits, stop_words, tfidf
from plainspeak.plans.training import feature_stages


def brute_join(words, pairs):
    out, i = [], 0
    while i < len(words):
        if i + 1 < len(words) and (words[i], words[i + 1]) in pairs:
            out.append(words[i] + "_" + words[i + 1])
            i += 2
        else:
            out.append(words[i])
            i += 1
    return " ".join(out)


def texts(seed=1, count=40):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice("a b c d e f".split()) for _ in range(rng.choice([0, 1, 2, 9, 40])))) for i in range(count)]


def test_join_phrases(spark):
    lexicon = {("a", "b"), ("b", "c"), ("c", "a"), ("d", "d"), ("a", "a")}
    table = spark.createDataFrame([(a, b, 5) for a, b in lexicon], "a string, b string, n bigint")
    docs = spark.createDataFrame(texts(), "id bigint, t string")
    got = {r["id"]: r["t"] for r in phrases.join_phrases(docs, table, "id", "t").collect()}
    assert got == {i: brute_join(t.split(), lexicon) for i, t in texts()}


def test_fit_phrases(spark):
    docs = texts(2, 200)
    pairs, words = Counter(), Counter()
    for _, t in docs:
        w = t.split()
        words.update(w)
        pairs.update(zip(w, w[1:]))
    total = sum(words.values())
    want = {}
    for (a, b), n in pairs.items():
        score = (n - 2) * total / (words[a] * words[b])
        if n >= 20 and score > 0.9:
            want[a, b] = (n, pytest.approx(score))
    frame = spark.createDataFrame(docs, "id bigint, t string")
    got = phrases.fit_phrases(frame, "t", min_count=20, threshold=0.9, discount=2).collect()
    assert want and {(r["a"], r["b"]): (r["n"], r["score"]) for r in got} == want


def test_term_weights_equal_the_pipeline(spark):
    docs = spark.createDataFrame(
        [(1, "a b  a"), (2, "b c "), (3, " c"), (4, "A\tb"), (5, "  "), (6, "")], "id bigint, t string"
    )
    model = Pipeline(stages=feature_stages("t")).fit(docs)
    terms = model.stages[1].vocabulary
    want = {
        (r["id"], terms[i]): v
        for r in model.transform(docs).collect()
        for i, v in zip(r["features"].indices, r["features"].values)
    }
    got = {(r["id"], r["term"]): r["tfidf"] for r in tfidf.term_weights(docs, "id", "t").collect()}
    assert got.keys() == {k for k in want} and all(math.isclose(got[k], want[k], abs_tol=1e-12) for k in want)


def test_stop_words_both_ways(spark):
    docs = spark.createDataFrame(texts(3) + [(999, None)], "id bigint, t string")
    listed = spark.createDataFrame([("a",), ("e",), ("zz",)], "word string")
    short = stop_words.remove_stop_words(docs, listed, "id", "t")
    long = stop_words.remove_stop_words(docs, listed, "id", "t", limit=1)
    want = {i: " ".join(w for w in t.split() if w not in ("a", "e")) for i, t in texts(3)} | {999: None}
    assert {r["id"]: r["t"] for r in short.collect()} == want
    assert {r["id"]: r["t"] for r in long.collect()} == want
    assert stop_words.bounded_list(listed, 2) is None


@pytest.mark.parametrize("limit", [0, 100])
def test_stop_words_of_repeated_keys_and_null_words(spark, limit):
    docs = spark.createDataFrame([(1, "a b"), (1, "a c"), (1, "a b"), (None, "b"), (2, "")], "id bigint, t string")
    listed = spark.createDataFrame([("a",), (None,), ("a",)], "word string")
    got = stop_words.remove_stop_words(docs, listed, "id", "t", limit=limit).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, "b"), (1, "c"), (1, "b"), (None, "b"), (2, "")]))


def test_pages(spark):
    html = '<p>one</p><p class="x"> two\n </p><p> </p><p>one</p><a href="/me?x">m</a><a href="/profile.php?id=1">p</a><a href="http://o.example/you">y</a><a href="/me">m</a>'
    df = spark.createDataFrame([(1, "https://h.example/q", html), (2, "https://h.example/q", "")], "page_id int, url string, html string")
    assert sorted(r["id"] for r in pages.link_ids(df).collect()) == ["me", "you"]
    assert [r["block"] for r in pages.page_blocks(df).collect()] == ["one", "two"]


def test_ids(spark):
    new = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "id string")
    seen = spark.createDataFrame([("b",), ("b",), (None,)], "id string")
    assert [r[0] for r in ids.unseen_ids(new, seen).collect()] == ["a"]
    assert [r[0] for r in ids.first_ids(new.filter("id is not null"), 1).collect()] == ["a"]


SCORED = [
    (100.0, "u1", "Xin chào!", 0),
    (161.0, "u2", "chào bạn", 2),
    (161.5, None, "xấu", 2),
    (None, "u1", "no time", 0),
    (220.0, "u3", "?", None),
]


@pytest.fixture(scope="module")
def scored(spark):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.createDataFrame(SCORED, "timestamp double, user string, comment string, prediction int")


def test_panels(spark, scored):
    assert [tuple(r) for r in panels.label_counts(scored).collect()] == [("Clean", 2), ("Hate", 2)]
    assert tuple(panels.label_counters(scored).first()) == (2, 0, 2)
    assert panels.distinct_users(scored).first()[0] == 4
    assert panels.approximate_users(scored).first()[0] == 4
    minutes = panels.label_by_minute(scored).collect()
    assert [(r["date_time"], r["clean"], r["offensive"], r["hate"]) for r in minutes] == [
        ("00:01 01-01-1970", 1, 0, 0), ("00:02 01-01-1970", 0, 0, 2),
    ]
    last = panels.recent_comments(scored, rows=3).collect()
    assert [r["Comment"] for r in last] == ["chào bạn", "xấu", "?"]
    assert last[0]["Prediction"] == "Hate" and last[0]["Time"] == "00:02:41" and last[0]["Date"] == "01-01-1970"
    assert tuple(panels.top_words(scored, 2).collect()[0]) == ("chào", 2)


def test_panels_on_no_rows(spark, scored):
    none = scored.filter("false")
    assert tuple(panels.label_counters(none).first()) == (0, 0, 0)
    assert panels.distinct_users(none).first()[0] == 0
    assert panels.top_words(none).count() == 0


def test_records(spark, scored):
    top = panels.top_words(scored, 2)
    got = panels.records(top, ["text", "size"], [-F.col("size"), F.col("text")]).first()[0]
    assert got == '[{"text":"chào","size":2},{"text":"bạn","size":1}]'


def test_metrics(spark):
    rows = [(0, 0), (0, 1), (1, 1), (1, 1), (0, 0), (None, 2), (1, None)]
    pairs = spark.createDataFrame(rows, "label_id int, prediction int")
    valid = pairs.filter("label_id is not null and prediction is not null")
    assert [tuple(r) for r in metrics.confusion_matrix(valid).collect()] == [(0, 2, 1, 0), (1, 0, 2, 0), (2, 0, 0, 0)]
    assert metrics.accuracy(valid).first()[0] == pytest.approx(4 / 5)
    assert metrics.f1_micro(valid).first()[0] == pytest.approx(4 / 5)
    assert metrics.f1_macro(valid).first()[0] == pytest.approx((0.8 + 0.8) / 2)
    assert [round(v, 6) for v in metrics.quality(valid).first()] == [0.8, 0.8, 0.8]
    # A missing prediction is a miss; a row without a label isn't counted.
    assert metrics.accuracy(pairs).first()[0] == metrics.quality(pairs).first()[0] == pytest.approx(4 / 6)
    more = spark.createDataFrame([*rows, (1, 7), (3, 0)], "label_id int, prediction int")
    matrix = metrics.confusion_matrix(more)
    assert matrix.columns == ["label_id", "predicted_0", "predicted_1", "predicted_2", "predicted_3", "predicted_7"]
    assert [tuple(r) for r in matrix.collect()] == [
        (0, 2, 1, 0, 0, 0), (1, 0, 2, 0, 0, 1), (2, 0, 0, 0, 0, 0), (3, 1, 0, 0, 0, 0), (7, 0, 0, 0, 0, 0),
    ]
    empty = valid.filter("false")
    assert metrics.f1_macro(empty).first()[0] is None and metrics.accuracy(empty).first()[0] is None


def test_log_loss(spark):
    df = spark.createDataFrame([(0, [0.5, 0.25, 0.25]), (2, [0.5, 0.5, 0.0])], "label_id int, scores array<float>")
    loss, hit = metrics.log_loss(df.unionByName(spark.createDataFrame([(None, [1.0, 0.0, 0.0])], df.schema))).first()
    assert loss == pytest.approx((-math.log(0.5) - math.log(1e-7)) / 2) and hit == 0.5


def test_splits(spark):
    rows = [(0, "Train", 1), (0, "Dev", 1), (2, "Test", 1), (0, "Train", 1)]
    tagged = spark.createDataFrame(rows, "label_id int, set string, counter int")
    assert sorted(tuple(r) for r in splits.label_counts_by_split(tagged).collect()) == [
        ("CLEAN", "Dev", 1), ("CLEAN", "Train", 2), ("HATE", "Test", 1),
    ]
    assert sorted(tuple(r) for r in splits.label_counts_after_resplit(tagged).collect()) == [
        ("CLEAN", "Train", 3), ("HATE", "Test", 1),
    ]
    assert sorted(tuple(r) for r in splits.rows_by_split(tagged).collect()) == [("Dev", 1), ("Test", 1), ("Train", 2)]


def test_frames(spark):
    wide = spark.range(0, 100, 1, 9)
    narrow = spark.range(0, 100, 1, 2)
    assert frames.spread(wide, "id").rdd.getNumPartitions() == 9
    assert frames.spread(narrow, "id").rdd.getNumPartitions() == 4
    assert not frames.is_live(wide) and not frames.is_empty(wide)
    assert frames.is_empty(wide.filter("id < 0"))
    kept = frames.compute_once(spark.createDataFrame([(1, None), (2, "")], "id int, t string"), "t", F.upper("t"))
    assert {tuple(r) for r in kept.collect()} == {(1, None), (2, "")}
