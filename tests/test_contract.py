"""The registered queries against DuckDB on the smallest tables, and their plans."""

import os

import pytest

import __spark_entry__ as contract
from checks.compare import compare, database
from checks.oracle import ORACLE
from checks.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")

MODELS = [n for n in QUERIES if n.startswith("model_")]


@pytest.fixture(scope="module")
def connection():
    return database(FOLDER)


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    # The word model is fitted by expectation steps; tests/test_segmentation.py checks all documents in plain Python.
    assert set(QUERIES) - {"segment_words"} == set(ORACLE)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in MODELS])
def test_query(spark, connection, name):
    ok, message, _ = compare(
        spark, connection, name, QUERIES[name], ORACLE.get(name), FOLDER
    )
    assert ok, message


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
@pytest.mark.parametrize("name", MODELS)
def test_model(spark, name):
    """On tables with enough labelled rows to learn from."""
    folder = "/root/testdata/sf0.01"
    ok, message, _ = compare(spark, database(folder), name, QUERIES[name], ORACLE[name], folder)
    assert ok, message


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", [n for n in ORACLE if not n.startswith(("stream_", "model_"))])
def test_plan_has_no_python_and_no_cross_join(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    for word in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in plan
