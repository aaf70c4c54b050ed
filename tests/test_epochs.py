"""Fits in epochs, stopped and taken up again; array models from a file."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from plainspeak.plans.epochs import finished_epochs, fit_epochs
from plainspeak.plans.scoring import shipped_model
from plainspeak.sources.artifacts import load_model


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(3)
    data = [(i, [float(x) for x in r.normal(size=4) + np.eye(4)[i % 3] * 2], i % 3) for i in range(120)]
    frame = spark.createDataFrame(data, "id bigint, v array<double>, label_id int")
    return frame.select("id", array_to_vector("v").alias("pooled"), "label_id").coalesce(1).cache()


def losses(fit):
    return [r["loss"] for r in fit.history.orderBy("epoch").collect()]


def test_a_stopped_fit_goes_on(spark, rows, tmp_path):
    train, dev = rows.filter("id < 80"), rows.filter("id >= 80")
    straight = fit_epochs(train, dev, str(tmp_path / "a"), 4, epochs=3, steps=3)
    path = str(tmp_path / "b")
    fit_epochs(train, dev, path, 4, epochs=1, steps=3)
    assert finished_epochs(spark, path) == 1
    # The next epoch stopped after its model was written: no loss, so it is fitted again.
    load_model(f"{path}/epoch-000/model").write().overwrite().save(f"{path}/epoch-001/model")
    assert finished_epochs(spark, path) == 1
    resumed = fit_epochs(train, dev, path, 4, epochs=3, steps=3)
    assert np.allclose(losses(straight), losses(resumed), atol=1e-9) and len(losses(straight)) == 3
    assert straight.best == resumed.best == int(np.argmin(losses(straight)))
    a, b = straight.model.stages[-1].weights, resumed.model.stages[-1].weights
    assert np.allclose(a.toArray(), b.toArray(), atol=1e-9)
    assert losses(straight)[-1] < losses(straight)[0]  # steps go on from the epoch before


def test_a_finished_fit_is_not_fitted_again(spark, rows, tmp_path):
    path = str(tmp_path / "a")
    first = fit_epochs(rows, rows, path, 4, epochs=2, steps=2)
    again = fit_epochs(rows.limit(0), rows, path, 4, epochs=2, steps=2)
    assert losses(first) == losses(again)


def test_no_validation_rows(spark, rows, tmp_path):
    fit = fit_epochs(rows, rows.limit(0), str(tmp_path / "a"), 4, epochs=2, steps=2)
    assert losses(fit) == [None, None] and fit.best == 1
    with pytest.raises(ValueError):
        fit_epochs(rows, rows, str(tmp_path / "b"), 4, epochs=0)


def test_model_file_is_loaded_once_a_worker(spark, tmp_path):
    weights, log = tmp_path / "weights-1.npy", str(tmp_path / "loads")
    np.save(weights, np.array([[0, 0, 0], [5, 1, 1], [1, 1, 7]]))

    def load(local):
        known = np.load(local)
        with open(log, "a") as f:
            f.write("x")
        return lambda batch: known[np.asarray(batch).astype(int)].sum(axis=1).astype(np.float32)

    frame = spark.createDataFrame([(i, [0, 1 + i % 2]) for i in range(50)], "id bigint, e array<int>").coalesce(1)
    scored = shipped_model(spark, str(weights), load, encoded="e", length=2, batch_size=8)(frame)
    assert [r["scores"] for r in scored.orderBy("id").collect()] == [[[5, 1, 1], [1, 1, 7]][i % 2] for i in range(50)]
    assert open(log).read() == "x"
    assert shipped_model(spark, str(weights), load, encoded="e", length=2)(frame.limit(0)).count() == 0
