import os
import zlib

import llm_cases
import numpy as np
import pytest

from plainspeak.llm import quality

FOLDER = "/root/testdata/sf0.01"


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string, score double")


def test_pairs_are_ranked():
    r = np.random.default_rng(1)
    good = r.random(600) < 0.8
    x = r.normal(size=(600, len(quality.FEATURES)))
    x[:, 2] += 3.0 * good
    x[:, 5] = 1.0  # a feature without spread
    model = quality.fit_pairs(x, good)
    order = model.strength(x)
    wins = (order[good][:, None] > order[~good][None]).mean()
    assert wins > 0.97 and model.weight[2] > 1
    # The threshold is the quantile that the share of bad rows cuts off, and gets the score 0.3.
    assert (model.score(x) < quality.ACCEPT).sum() == (~good).sum()


def test_gradient_of_the_loss_is_zero_at_the_fit():
    r = np.random.default_rng(2)
    good = r.random(200) < 0.5
    x = r.normal(size=(200, len(quality.FEATURES))) + 0.4 * good[:, None]
    model = quality.fit_pairs(x, good, opponents=3)
    again = quality.fit_pairs(x, good, opponents=3, steps=200)
    assert np.allclose(model.weight, again.weight, atol=1e-6)


@pytest.mark.parametrize("good", [[], [True] * 3, [False] * 3])
def test_nothing_to_learn_from(good):
    model = quality.fit_pairs(np.zeros((len(good), len(quality.FEATURES))), np.array(good, bool))
    assert (model.score(np.zeros((2, len(quality.FEATURES)))) >= quality.ACCEPT - 1e-12).all()


def test_odd_rows(spark):
    docs = llm_cases.rows(spark)
    given = labels(spark, [(1, 1, 0, "x", 0.0), (2, 1, 0, "x", 0.0), (10, 0, 0, "x", 0.0), (7, None, 0, "x", 0.0), (None, 1, 0, "", 0.0)])
    model = quality.fit(docs, given)
    rows = quality.score(docs, model).collect()
    assert sorted([r["doc_id"] for r in rows], key=str) == sorted([r[0] for r in llm_cases.ROWS], key=str)
    for r in rows:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    assert len({r["score"] for r in rows if r["doc_id"] in (4, 5, 6)}) == 1
    kept = quality.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] for r in rows)
    assert quality.score(llm_cases.none(spark), quality.fit(llm_cases.none(spark), labels(spark, []))).count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_threshold_is_that_of_all_labelled_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    known = spark.read.parquet(f"{FOLDER}/labels.parquet")
    model = quality.fit(docs, known, fit_rows=150)
    rows = docs.join(known, "doc_id").filter("quality IS NOT NULL").filter(~quality.held_out(docs["doc_id"])).collect()
    assert len(rows) > 200
    ranked = np.sort(model.strength(np.array([quality.features(r["text"] or "") for r in rows])))
    bad = sum(r["quality"] == 0 for r in rows)
    assert model.threshold == pytest.approx((ranked[bad - 1] + ranked[bad]) / 2, abs=1e-12)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    known = spark.read.parquet(f"{FOLDER}/labels.parquet")
    scored = quality.score(docs, quality.fit(docs, known)).filter("held_out").join(known, "doc_id").collect()
    good = np.array([r["score"] for r in scored if r["quality"] == 1])
    bad = np.array([r["score"] for r in scored if r["quality"] == 0])
    assert len(good) > 40 and len(bad) > 3
    assert (good[:, None] > bad[None]).mean() > 0.97
    assert (good >= quality.ACCEPT).mean() > 0.95 and (bad < quality.ACCEPT).mean() > 0.7
