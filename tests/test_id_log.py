"""The growing log of ids: exact answers, no shuffle of the log."""

import random
import re
import uuid

from pyspark.sql import functions as F

from plainspeak.operators.id_log import IdLog
from plainspeak.session import stored


def named(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def test_unseen_against_a_set(spark):
    log, seen, rng = IdLog(spark, "log_" + uuid.uuid4().hex, buckets=8), set(), random.Random(5)
    assert log.unseen(named(spark, ["a", "a", None, ""])).collect() == [("a",)]
    for _ in range(4):
        new = [f"p{rng.randrange(300)}" for _ in range(120)] + [None, "", "đ ẻ", "hot"] * 3
        fresh = log.add_unseen(named(spark, new), lambda rows: stored(rows, "fresh"))
        expected = {i for i in new if i} - seen
        assert sorted(r["id"] for r in fresh.collect()) == sorted(expected)
        seen |= expected
    assert sorted(r["id"] for r in log.table().collect()) == sorted(seen)
    assert log.unseen(named(spark, [])).count() == 0
    assert log.unseen(log.table()).count() == 0


def test_ids_added_twice_count_once(spark):
    log = IdLog(spark, "log_" + uuid.uuid4().hex, buckets=4)
    for _ in range(2):
        log.add(named(spark, ["a", "b"]))
    assert log.table().count() == 4
    assert sorted(r["id"] for r in log.unseen(named(spark, ["a", "c", "c"])).collect()) == ["c"]


def test_the_log_is_not_shuffled(spark):
    log = IdLog(spark, "log_" + uuid.uuid4().hex, buckets=8)
    log.add(spark.range(50_000).select(F.col("id").cast("string")))
    unseen = log.unseen(spark.range(49_000, 51_000).select(F.col("id").cast("string")))
    assert unseen.count() == 1000
    plan = unseen._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "LeftAnti" in plan
    physical = unseen._jdf.queryExecution().sparkPlan().toString() + unseen._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in physical
    # Walking up from the scan of the log, the first operator that is not its own filter or sort is the join.
    lines = unseen._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].splitlines()
    scan = next(i for i, line in enumerate(lines) if "Bucketed: true" in line)
    above = []
    for line in reversed(lines[:scan]):
        name = re.sub(r"^[\s:+\-*()\d]*", "", line).split(" ")[0]
        above.append(name)
        if "Join" in name:
            break
    assert above[-1] == "SortMergeJoin" and not {"Exchange", "ShuffleQueryStage"} & set(above)
