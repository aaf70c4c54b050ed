import re
from collections import defaultdict

import llm_cases
import pytest
from pyspark.sql import functions as F

from plainspeak.llm import exact


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc_id)
    out = []
    for members in groups.values():
        least = min((m for m in members if m is not None), default=None)
        out += [(m, least, len(members), m == least) for m in members]
    return sorted(out, key=str)


@pytest.mark.parametrize("digest", [exact.sha256, lambda c: F.substring(exact.sha256(c), 1, 1)], ids=["sha256", "weak"])
def test_against_brute_force(spark, digest):
    found = exact.exact_duplicates(llm_cases.rows(spark), digest=digest, salts=3).repartition(3)
    got = [(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in found.collect()]
    assert sorted(got, key=str) == brute(llm_cases.ROWS)


def test_hot_text_over_many_partitions(spark):
    docs = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same text").otherwise(F.concat(F.lit("t"), "id")).alias("text")
    ).repartition(40)
    found = exact.exact_duplicates(docs)
    assert found.filter("kept").count() == 4000 - 1334 + 1
    assert found.filter("keep_id = 0 AND group_size = 1334").count() == 1334


def test_kept_rows_have_all_columns(spark):
    docs = llm_cases.rows(spark)
    kept = exact.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    ids = sorted([r["doc_id"] for r in kept.collect()], key=str)
    assert ids == sorted([1, 2, 4, 6, 7, 9, 9, 10, None], key=str)


def test_empty_table(spark):
    assert exact.exact_duplicates(llm_cases.none(spark)).count() == 0
    assert exact.drop_exact_duplicates(llm_cases.none(spark)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = exact.exact_duplicates(llm_cases.rows(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|MapIn", plan)
