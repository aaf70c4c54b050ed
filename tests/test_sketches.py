"""Sketches against exact counts: their bounds, merging in any order, ranges, repeated delivery."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plainspeak.operators import sketches
from plainspeak.streaming import aggregates, sinks
from plainspeak.streaming.summaries import Summaries

ROWS = "event_time timestamp, user string, comment string"
START = datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def utc(spark):
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def rows(count, seed=1):
    rng = random.Random(seed)
    for _ in range(count):
        words = " ".join(f"w{min(int(rng.paretovariate(0.7)), 3000)}" for _ in range(rng.randrange(6)))
        stamp = START + timedelta(seconds=rng.randrange(4 * 3600)) if rng.random() < 0.98 else None
        yield stamp, f"u{rng.randrange(400)}" if rng.random() < 0.97 else None, words if rng.random() < 0.95 else None


def exact(data, first=None, last=None):
    inside = [r for r in data if (first is None or (r[0] and r[0] >= first)) and (last is None or (r[0] and r[0] < last))]
    return len({r[1] for r in inside}), Counter(w for r in inside for w in (r[2] or "").split())


def within(found, counts, tracked):
    bound = -(-sum(counts.values()) * 2.625 // tracked)
    shown = {r["text"]: r for r in found}
    assert all(r["bound"] == bound and counts[w] <= r["size"] <= counts[w] + bound for w, r in shown.items())
    assert all(w in shown for w, n in counts.items() if n > 2 * bound)


@pytest.mark.parametrize("tracked", [64, 5000])
def test_word_sketches_keep_their_bound(spark, tracked):
    data = list(rows(2500))
    frame = spark.createDataFrame(data, ROWS).repartition(5)
    counts = exact(data)[1]
    hours = sketches.word_sketches(frame, sketches.bucket(unit="hour"), tracked=tracked)
    assert hours.columns == ["hour", "words", "seen"]
    for parts in (hours, sketches.merge_words(hours, F.hour("hour").alias("h"), tracked=tracked)):
        within(sketches.frequent_words(parts, 5000, tracked).collect(), counts, tracked)
    if tracked == 5000:  # more counters than words: exact
        best = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:20]
        sizes = [(r["text"], r["size"]) for r in sketches.frequent_words(hours, 20, tracked).collect()]
        assert sizes == best


def test_word_sketches_of_nothing(spark):
    none = spark.createDataFrame([], ROWS)
    assert sketches.frequent_words(sketches.word_sketches(none), 5).count() == 0
    blank = spark.createDataFrame([(START, "u", ""), (START, "u", None)], ROWS)
    assert sketches.frequent_words(sketches.word_sketches(blank, sketches.bucket()), 5).count() == 0


def test_user_sketches(spark):
    data = list(rows(3000))
    minutes = sketches.user_sketches(spark.createDataFrame(data, ROWS), sketches.bucket())
    users, _ = exact(data)
    assert abs(sketches.count_users(minutes).first()[0] - users) <= 0.05 * users
    assert sketches.count_users(minutes.limit(0)).first()[0] == 0
    nameless = spark.createDataFrame([(START, None, "a"), (START, None, "b")], ROWS)
    assert sketches.count_users(sketches.user_sketches(nameless)).first()[0] == 1


def test_rolling_days(spark):
    data = [(START + timedelta(days=d), f"u{d % 3}", "") for d in (0, 1, 2, 5)]
    minutes = sketches.user_sketches(spark.createDataFrame(data, ROWS), sketches.bucket())
    days = sketches.count_users(sketches.rolling(minutes, 3), F.col("first_day"))
    shown = {(r["first_day"] - START.date()).days: r["count_user"] for r in days.collect()}
    assert shown == {-2: 1, -1: 2, 0: 3, 1: 2, 2: 1, 3: 1, 4: 1, 5: 1}


@pytest.mark.parametrize("merge_every", [100, 2])
def test_summaries(spark, tmp_path, merge_every):
    data = list(rows(900, 3))
    kept = Summaries(spark, str(tmp_path / "s"), merge_every, tracked=4000)
    assert kept.users().first()[0] == 0 and kept.top_words(5).count() == 0
    for i in range(5):
        part = spark.createDataFrame(data[i * 180 : i * 180 + 180], ROWS)
        kept.deliver(part, i)
        kept.deliver(part, i)  # delivered again
    for first, last in ((None, None), (START + timedelta(hours=1), START + timedelta(hours=3))):
        users, counts = exact(data, first, last)
        assert abs(kept.users(first, last).first()[0] - users) <= 0.05 * users
        within(kept.top_words(4000, first, last).collect(), counts, 4000)
    folders = [p.name for p in (tmp_path / "s" / "words").iterdir()]
    assert len(folders) == 5 if merge_every == 100 else len(folders) <= 5 and "base-3" in folders


def test_new_users_are_exact_and_state_is_dropped(spark, tmp_path):
    inbox = str(tmp_path / "in")
    data = [(START + timedelta(seconds=s), u) for s, u in [(0, "a"), (5, "a"), (59, "b"), (60, "a"), (61, None), (62, None)]]
    later = [(START + timedelta(hours=1, seconds=s), u) for s, u in [(0, "a"), (1, "a"), (2, "c")]]
    last = [(START + timedelta(hours=2), "z"), (START, "too late")]
    out = str(tmp_path / "out")
    for part in (data, later, last):
        spark.createDataFrame(part, "event_time timestamp, user string").coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema("event_time timestamp, user string").parquet(inbox)
        query = sinks.append_table(aggregates.new_users(stream), out, every=None)
        sinks.finish(query)
    state = query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"]
    assert state == 1  # the newest minute only
    found = sorted(((r["minute"] - START).seconds // 60, r["user"] or "") for r in spark.read.parquet(f"{out}/table").collect())
    assert found == [(0, "a"), (0, "b"), (1, ""), (1, "a"), (60, "a"), (60, "c"), (120, "z")]
