import os
from collections import defaultdict

import llm_cases
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from checks.compare import compare, database
from plainspeak.llm import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, name):
    ok, message, _ = compare(spark, database(FOLDER), name, queries.QUERIES[name], queries.ORACLE[name], FOLDER)
    assert ok, message


def test_all_are_registered():
    names = [n for n in contract.queries() if n.startswith("op") or n == "pipeline"]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n != "pipeline") == [*range(1, 11), *(n for n in (11, 12, 13) if any(x.startswith(f"op{n}_") for x in names))]
    assert "pipeline" in names and [n for n, _ in corpus_pipeline.STAGES][2] == "simhash"


def test_stages_are_their_operators(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.keep(stage(spark, before, FOLDER), f"test-{name}")
        assert after.columns == columns and after.dtypes == docs.dtypes
        assert after.join(before, columns, "left_semi").count() == after.count() > 0
        if name == "exact_dedup":
            assert after.count() == queries.exact.exact_duplicates(before).filter("kept").count()
        if name == "simhash":
            assert after.count() == queries.simhash.near_duplicates(before).select("component_id").distinct().count()
        before = after
    last = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r["doc_id"] for r in last} == {r["doc_id"] for r in before.collect()}
    used = defaultdict(int)
    for r in last:
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 1024


@pytest.mark.parametrize("make", [llm_cases.rows, llm_cases.none], ids=["odd", "empty"])
def test_stages_take_odd_rows(spark, make, tmp_path):
    spark.createDataFrame([(1, 1, 0), (2, 1, 0), (10, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = make(spark)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.keep(stage(spark, docs, str(tmp_path)), f"odd-{name}")
    if make is llm_cases.none:
        assert docs.count() == 0
