"""Streams against batch, restarts, repeated delivery."""

import json
import os
import random
import uuid
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from plainspeak.functions import text as X
from plainspeak.operators import panels
from plainspeak.operators.frames import compute_once
from plainspeak.plans.cleaning import clean_comments
from plainspeak.sources.comments import read_comments, stream_comments
from plainspeak.streaming import aggregates, sinks
from plainspeak.streaming.board import SCORED, Board
from plainspeak.streaming.timeline import Timeline


def add_files(folder, first, count, user=None):
    folder.mkdir(exist_ok=True)
    for i in range(first, first + count):
        record = {
            "user": user or f"u{i % 5}",
            "comment": f"Số {i % 7} @bob #tag www.x.y   {'!' * (i % 3)}",
            "timestamp": f"{1657594740 + i * 13}.25",
        }
        (folder / f"{i}_{uuid.uuid4()}.json").write_text(json.dumps(record, ensure_ascii=False))


def score(batch):
    cleaned = compute_once(batch, "comment_norm", X.normalise("comment")).filter("comment_norm != ''")
    prediction = F.pmod(F.length("comment_norm"), F.lit(3)).cast("int")
    return cleaned.select("timestamp", "user", F.col("comment_norm").alias("comment"), prediction.alias("prediction"))


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


@pytest.fixture(autouse=True)
def utc(spark):
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_stream_equals_batch_and_restarts(spark, tmp_path):
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    add_files(inbox, 0, 20)
    (inbox / "broken.json").write_text("{oops")
    cleaned = lambda: clean_comments(stream_comments(spark, str(inbox)), ["số"])
    assert cleaned().isStreaming
    sinks.finish(sinks.append_table(cleaned(), out, every=None))
    assert spark.read.parquet(f"{out}/table").count() == 20
    add_files(inbox, 20, 10)
    query = sinks.append_table(cleaned(), out, every=None)
    sinks.finish(query)
    assert sinks.rows_read(query) == 10 and not sinks.is_alive(query)
    batch = clean_comments(read_comments(spark, str(inbox)), ["số"])
    table = spark.read.parquet(f"{out}/table").select(*batch.columns)
    assert table.count() == 30 and same(table, batch)


def test_memory_table_and_sql(spark, tmp_path):
    add_files(tmp_path / "in", 0, 4)
    name = "live_" + uuid.uuid4().hex
    query = sinks.memory_table(stream_comments(spark, str(tmp_path / "in"), 1), name, every="1 second")
    query.processAllAvailable()
    assert sinks.is_alive(query)
    query.stop()
    assert spark.sql(f"SELECT * FROM {name}").count() == 4


@pytest.mark.parametrize("merge_every", [500, 2])
def test_board_over_many_batches(spark, tmp_path, merge_every):
    inbox = tmp_path / "in"
    add_files(inbox, 0, 30)
    board = Board(spark, str(tmp_path / "board"), score, merge_every)
    sinks.finish(board.start(stream_comments(spark, str(inbox), files_per_trigger=7), every=None))
    assert board.scored().select("batch").distinct().count() == 5
    whole = spark.createDataFrame(score(read_comments(spark, str(inbox))).collect(), SCORED)
    assert same(board.label_counts().orderBy("label"), panels.label_counts(whole).orderBy("label"))
    minutes = panels.label_by_minute(whole).drop("date_time")
    assert same(board.label_by_minute(), minutes.select(*board.label_by_minute().columns))
    assert same(board.recent(), panels.recent_comments(whole))
    assert same(board.top_words(), panels.top_words(whole))
    assert board.counters().first()["count_user"] == 5
    assert board._base() == (3 if merge_every == 2 else None)
    shown = {r["panel"]: json.loads(r["records"]) for r in board.snapshot().collect()}
    assert shown["counters"][0]["count_user"] == 5 and sum(r["n"] for r in shown["labels"]) == 30


def test_board_repeated_delivery(spark, tmp_path):
    add_files(tmp_path / "in", 0, 9)
    board = Board(spark, str(tmp_path / "board"), score)
    batch = read_comments(spark, str(tmp_path / "in"))
    board.deliver(batch, 0)
    board.deliver(batch.limit(3), 1)
    before = sorted(board.scored().collect(), key=str), board.snapshot().collect()
    board.deliver(batch, 0)
    assert (sorted(board.scored().collect(), key=str), board.snapshot().collect()) == before


def test_board_merge_again(spark, tmp_path):
    """A batch repeated after its merge: the base is kept, nothing is counted twice."""
    add_files(tmp_path / "in", 0, 9)
    board = Board(spark, str(tmp_path / "board"), score, merge_every=1)
    batch = read_comments(spark, str(tmp_path / "in"))
    for i in (0, 1, 1, 2, 2):
        board.deliver(batch, i)
    assert sum(r["n"] for r in board.label_counts().collect()) == 27
    assert board._base() == 1 and board.partial("words").agg(F.sum("size")).first()[0] > 0


def test_board_keeps_a_bounded_number_of_folders(spark, tmp_path):
    board = Board(spark, str(tmp_path / "board"), merge_every=3)
    rows = spark.createDataFrame([(60.0, "u", "x y", 1), (None, "v", "x", 0)], SCORED).coalesce(1)
    kept = []
    for i in range(20):
        board.deliver(rows, i)
        kept.append(len(list((tmp_path / "board" / "parts").iterdir())))
        assert len(list((tmp_path / "board" / "log").iterdir())) == kept[-1]
    assert max(kept[10:]) <= 2 * 3 + 2
    assert sum(r["n"] for r in board.label_counts().collect()) == 40
    assert {r["text"]: r["size"] for r in board.top_words().collect()} == {"x": 40, "y": 20}


def test_a_batch_counts_when_its_last_table_is_there(spark, tmp_path, monkeypatch):
    board = Board(spark, str(tmp_path / "board"))
    rows = spark.createDataFrame([(60.0, "u", "x", 1)], SCORED)
    board.deliver(rows, 0)
    monkeypatch.setattr("plainspeak.streaming.board._last", lambda rows: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        board.deliver(rows, 1)
    monkeypatch.undo()
    assert board.label_counts().first()["n"] == 1
    board.deliver(rows, 1)
    assert board.label_counts().first()["n"] == 2


def test_what_scoring_stores_is_gone_with_the_batch(spark, tmp_path):
    import glob

    from plainspeak.plans.encoding import with_row_ids
    from plainspeak.session import shared_folder

    pattern = shared_folder(spark).removeprefix("file:") + "/rows-*"
    before = set(glob.glob(pattern))
    board = Board(spark, str(tmp_path / "board"), lambda batch: with_row_ids(batch).drop("row_id"))
    board.deliver(spark.createDataFrame([(60.0, "u", "x", 1)], SCORED), 0)
    assert board.label_counts().first()["n"] == 1 and set(glob.glob(pattern)) == before


def test_board_hot_user_and_no_time(spark, tmp_path):
    rows = [(None, "u", "x", 1)] * 5 + [(60.0, None, "x y", 0)]
    board = Board(spark, str(tmp_path / "board"))
    board.deliver(spark.createDataFrame(rows, SCORED), 0)
    assert tuple(board.counters().first()) == (1, 5, 0, 2)
    assert board.label_by_minute().count() == 1 and board.recent().count() == 1


def test_running_aggregates(spark, tmp_path):
    inbox = tmp_path / "in"
    add_files(inbox, 0, 30)
    scored = lambda s: s.withColumn("prediction", F.pmod(F.length("comment"), F.lit(3)).cast("int"))
    stream = scored(stream_comments(spark, str(inbox), files_per_trigger=11))
    batch = scored(read_comments(spark, str(inbox)))
    counts = sinks.run_to_table(aggregates.running_label_counts(stream), "counts", "complete")
    assert same(counts.orderBy("label"), panels.label_counts(batch).orderBy("label"))
    users = sinks.run_to_table(aggregates.running_users(stream), "users", "complete")
    assert users.first()["count_user"] == 5
    minutes = sinks.run_to_table(aggregates.minute_counts(stream), "minutes", "complete")
    want = panels.label_by_minute(batch).drop("date_time")
    assert same(minutes.orderBy("minute"), want.select(*minutes.columns).orderBy("minute"))


def test_minutes_come_out_once_in_append_mode(spark, tmp_path):
    inbox = tmp_path / "in"
    add_files(inbox, 0, 60)
    stream = stream_comments(spark, str(inbox), files_per_trigger=20).withColumn("prediction", F.lit(1))
    got = sinks.run_to_table(aggregates.minute_counts(stream, "1 minute"), "closed").collect()
    assert got and len({r["minute"] for r in got}) == len(got)


def test_repeats_pass_once(spark, tmp_path):
    inbox = tmp_path / "in"
    add_files(inbox, 0, 40, user="same")
    stream = stream_comments(spark, str(inbox), files_per_trigger=15)
    once = aggregates.drop_repeats(stream, "1 day").select("user", "comment")
    got = sinks.run_to_table(once, "once")
    want = read_comments(spark, str(inbox)).select("user", "comment").distinct()
    assert want.count() < 40 and same(got, want)


def test_repeats_pass_again_after_the_delay(spark, tmp_path):
    """One pair at 0 s, 52 s and 107 s, another moves the watermark on before the third arrives."""
    inbox = tmp_path / "in"
    inbox.mkdir()
    for i, (user, at) in enumerate([("a", 0.0), ("a", 52.05), ("b", 125.0), ("b2", 126.0), ("a", 106.9)]):
        record = {"user": user, "comment": "same", "timestamp": f"{1657594800 + at:.6f}"}
        path = inbox / f"{i}.json"
        path.write_text(json.dumps(record))
        os.utime(path, (1657594800 + i, 1657594800 + i))
    stream = stream_comments(spark, str(inbox), files_per_trigger=1)
    once = aggregates.drop_repeats(stream, "1 minute").select("user", "timestamp")
    got = sorted((r["user"], round(r["timestamp"] - 1657594800, 2)) for r in sinks.run_to_table(once, "again").collect())
    assert got == [("a", 0.0), ("a", 106.9), ("b", 125.0), ("b2", 126.0)]


def test_intake_counter(spark):
    from pyspark.sql import Observation

    seen = Observation("n")
    spark.range(12).observe(seen, F.count(F.lit(1)).alias("rows")).count()
    assert seen.get["rows"] == 12
    assert sinks.count_intake(spark.range(3)).count() == 3


def test_follow(spark, tmp_path):
    add_files(tmp_path / "in", 0, 3)
    query = sinks.append_table(stream_comments(spark, str(tmp_path / "in")), str(tmp_path / "out"), every=None)
    shown = []
    sinks.follow(query, lambda: shown.append(query.isActive), seconds=0.2)
    assert not query.isActive and spark.read.parquet(str(tmp_path / "out" / "table")).count() == 3


def minute_rows(spark, rows):
    """Rows of (id, seconds or None, prediction)."""
    frame = spark.createDataFrame(rows, "id int, seconds double, prediction int")
    return frame.select("id", F.timestamp_seconds("seconds").alias("event_time"), "prediction")


def expected_minutes(batches, delay):
    """Plain Python: (minute -> counts), ids left out."""
    newest, counts, late = None, {}, []
    for rows in batches:
        for number, seconds, prediction in rows:
            minute = None if seconds is None else int(seconds // 60)
            if minute is None or (newest is not None and (minute + 1) * 60 <= newest - delay):
                late.append(number)
                continue
            counts.setdefault(minute, [0, 0, 0])
            if prediction in (0, 1, 2):
                counts[minute][prediction] += 1
        newest = max([s for _, s, _ in rows if s is not None] + ([] if newest is None else [newest]), default=None)
    return counts, sorted(late)


def shown_minutes(frame):
    columns = [F.unix_seconds("minute").alias("s"), "clean", "offensive", "hate"]
    return {r[0] // 60: list(r[1:]) for r in frame.select(*columns).collect()}


@pytest.mark.parametrize("merge_every", [100, 2])
def test_timeline_with_late_rows(spark, tmp_path, merge_every):
    rng = random.Random(7)
    batches, number = [], 0
    for i in range(7):
        rows = []
        for _ in range(25):
            number += 1
            seconds = None if rng.random() < 0.05 else 600.0 * i + rng.choice([0.0, 60.0, -1200.0, 59.999, 240.5]) + 3600
            rows.append((number, seconds, rng.choice([0, 1, 2, None])))
        batches.append([] if i == 3 else rows)
    line = Timeline(spark, str(tmp_path / "line"), timedelta(minutes=10), merge_every)
    assert line.minutes().count() == 0 and line.late_rows() is None
    for i, rows in enumerate(batches):
        batch = minute_rows(spark, rows)
        line.deliver(batch, i)
        if i % 2:
            line.deliver(batch, i)  # delivered again
        counts, late = expected_minutes(batches[: i + 1], 600)
        assert shown_minutes(line.minutes()) == counts
        assert sorted(r["id"] for r in line.late_rows().collect()) == late if late else line.late_rows() is None
    assert late and {r["reason"] for r in line.late_rows().collect()} == {"late", "no time"}
    line.deliver(minute_rows(spark, batches[2]), 2)  # long past
    assert shown_minutes(line.minutes()) == counts
    everything = {}
    for rows in batches:
        for _, seconds, prediction in rows:
            if seconds is not None:
                kept = everything.setdefault(int(seconds // 60), [0, 0, 0])
                if prediction is not None:
                    kept[prediction] += 1
    assert shown_minutes(line.minutes(with_late=True)) == everything
    kept = lambda name: len(list((tmp_path / "line" / name).iterdir()))
    assert kept("open") == 2 and kept("closed") <= (7 if merge_every == 100 else 5)


def test_timeline_crash_before_the_entry(spark, tmp_path):
    """Tables without an entry are not read, and the delivery that follows replaces them."""
    line = Timeline(spark, str(tmp_path / "line"))
    first = minute_rows(spark, [(1, 0.0, 0), (2, 5000.0, 1)])
    line.deliver(first, 0)
    half = minute_rows(spark, [(3, 10.0, 2), (4, 5001.0, 2)])
    line.deliver(half, 1)
    entry = next(p for p in (tmp_path / "line" / "log").iterdir() if p.name.startswith(f"{1:012d}"))
    entry.rmdir()
    assert shown_minutes(line.minutes()) == {0: [1, 0, 0], 83: [0, 1, 0]} and line.late_rows() is None
    line.deliver(half, 1)
    assert shown_minutes(line.minutes()) == {0: [1, 0, 0], 83: [0, 1, 1]}
    assert [r["id"] for r in line.late_rows().collect()] == [3]
    assert shown_minutes(line.minutes(with_late=True)) == {0: [1, 0, 1], 83: [0, 1, 1]}


def test_staged_files_follow_the_input(spark, tmp_path):
    from checks import tables
    from plainspeak.session import folder_names

    docs = spark.range(240).selectExpr("id AS doc_id", "concat('text ', id) AS text", "9L AS n_chars")
    docs.repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    events = spark.range(240).selectExpr("id AS event_id", "timestamp_seconds(id) AS ts", "id AS user_id")
    events.write.parquet(f"{tmp_path}/events.parquet")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        tables.document_stream(spark, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    staged = tables._STAGED[spark.sparkContext.applicationId, str(tmp_path), "document-inbox"]
    files = [n for n in folder_names(spark, staged) if n.startswith("part-")]
    assert len(files) > 4
    assert spark.read.json(staged).count() == 240
