"""Models: fit, beat the majority, save, load, score batch and stream alike."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plainspeak.plans import training
from plainspeak.plans.cleaning import clean_comments, clean_corpus
from plainspeak.plans.scoring import array_model, from_scores, score_comments
from plainspeak.sources.artifacts import load_model, save_model

WORDS = {0: "good fine nice kind", 1: "silly fool rude mean", 2: "hate kill burn gone"}


@pytest.fixture(scope="module")
def data(spark):
    rows = []
    for i in range(90):
        c = i % 3 if i % 10 else 0
        w = WORDS[c].split()
        rows.append((i, f"{w[i % 4]} the thing {w[(i + 1) % 4]} {i % 6}", str(c)))
    rows += [(900, "x y", "7"), (901, "   ", "1"), (902, "the", "1")]
    raw = spark.createDataFrame(rows, "id bigint, free_text string, label_id string")
    return clean_corpus(raw, ["the"]).cache()


def test_clean_corpus(data):
    assert data.count() == 90
    assert {r[0] for r in data.select("label_id").distinct().collect()} == {0, 1, 2}


@pytest.mark.parametrize("name", training.TEXT_MODELS)
def test_text_models(spark, data, tmp_path, name):
    model = training.fit(name, data)
    scored = training.predictions(model, data)
    hits = scored.filter("label_id = prediction").count()
    majority = data.groupBy("label_id").count().agg(F.max("count")).first()[0]
    assert scored.count() == 90 and hits > majority
    assert {r[0] for r in scored.select("prediction").distinct().collect()} <= {0, 1, 2}
    quality = training.evaluate(model, data).first()
    assert quality["accuracy"] == pytest.approx(hits / 90) == quality["f1_micro"]
    save_model(model, str(tmp_path / name))
    again = training.predictions(load_model(str(tmp_path / name)), data)
    pick = ["id", "prediction"]
    assert sorted(again.select(*pick).collect()) == sorted(scored.select(*pick).collect())


def test_word_vector_model(spark, data, tmp_path):
    names = sorted({w for ws in WORDS.values() for w in ws.split()})
    rng = np.random.default_rng(1)
    vectors = spark.createDataFrame(
        [(w, [float(x) for x in rng.normal(size=8)]) for w in names], "word string, vec array<float>"
    )
    features = training.VectorFeatures.fit(data, vectors, "id", "text_clean", 8)
    model = training.fit_vector_model(features, data, "id")
    scored = training.predictions(model, features.transform(data, "id", "text_clean"))
    hits = scored.filter("label_id = prediction").count()
    assert scored.count() == 90 and hits > 45
    save_model(model, str(tmp_path / "m"))
    again = training.predictions(load_model(str(tmp_path / "m")), features.transform(data, "id", "text_clean"))
    assert again.filter("label_id = prediction").count() == hits


def test_unknown_model():
    with pytest.raises(ValueError):
        training.build_model("no_such_model")


def test_score_comments(spark, data):
    model = training.fit("naive_bayes", data)
    rows = [(1.0, "u", "Good and nice"), (2.0, "v", "HATE burn"), (3.0, "w", "  ")]
    cleaned = clean_comments(spark.createDataFrame(rows, "timestamp double, user string, comment string"))
    got = score_comments(model, cleaned)
    assert got.columns == ["timestamp", "user", "comment", "prediction"]
    assert [(r["comment"], r["prediction"]) for r in got.orderBy("timestamp").collect()] == [
        ("good and nice", 0), ("hate burn", 2),
    ]


def test_array_model(spark):
    def make_predict():
        def predict(batch):
            total = np.asarray(batch).sum(axis=1)
            out = np.zeros((len(total), 3), dtype=np.float32)
            out[np.arange(len(total)), (total % 3).astype(int)] = 1.0
            return out

        return predict

    df = spark.createDataFrame(
        [(1.0, "u", "c", [0, 1, 1]), (2.0, "u", "d", [0, 0, 3])],
        "timestamp double, user string, comment string, comment_encoded array<int>",
    )
    got = from_scores(array_model(make_predict, length=3)(df))
    assert [r["prediction"] for r in got.orderBy("timestamp").collect()] == [2, 0]


def test_stream_to_array_model(spark, tmp_path):
    """Stream, clean, encode, score with an array model, deliver."""
    import json

    from plainspeak.operators.vocabulary import fit_vocabulary
    from plainspeak.plans.encoding import encode_comments
    from plainspeak.session import stored
    from plainspeak.sources.comments import stream_comments
    from plainspeak.streaming import sinks
    from plainspeak.streaming.board import Board

    inbox = tmp_path / "in"
    inbox.mkdir()
    for i, text in enumerate(["good fine", "hate burn", "Good @x unseen", "hate", "same", "same"]):
        record = {"user": f"u{i}", "comment": text, "timestamp": str(1000.5 + i)}
        (inbox / f"{i}.json").write_text(json.dumps(record))
    fitted = spark.createDataFrame([(1, "hate burn"), (2, "good fine")], "id bigint, t string")
    vocabulary = stored(fit_vocabulary(fitted, "id", "t"), "vocabulary")

    def make_predict():
        def predict(batch):
            ids = np.asarray(batch)
            bad, good = np.isin(ids, [1, 2]).any(axis=1), np.isin(ids, [3, 4]).any(axis=1)
            return np.stack([good, ~(good | bad), bad], axis=1).astype(np.float32)

        return predict

    model = array_model(make_predict)

    def score(batch):
        return from_scores(model(encode_comments(clean_comments(batch), vocabulary)), "comment_norm")

    board = Board(spark, str(tmp_path / "board"), score)
    sinks.finish(board.start(stream_comments(spark, str(inbox), files_per_trigger=4), every=None))
    rows = board.scored().orderBy("timestamp").collect()
    assert [r["prediction"] for r in rows] == [0, 2, 0, 2, 1, 1]
    assert [r["comment"] for r in rows][:3] == ["good fine", "hate burn", "good unseen"]
