"""Broken lines, archived files and progress of the intake."""

import json

import pytest
from pyspark.sql import types as T

from plainspeak.session import make_folder
from plainspeak.sources import intake
from plainspeak.streaming import sinks
from plainspeak.streaming.progress import ProgressLog

EXTRA = T.StructType([T.StructField("number", T.IntegerType(), True)])


@pytest.fixture(autouse=True)
def utc(spark):
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def record(number):
    return json.dumps({"user": f"u{number}", "comment": "Số\tmột", "timestamp": f"{1657594740 + number}.5", "number": number})


def fill(folder, name, lines):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join(lines))


def test_broken_lines_and_archive(spark, tmp_path):
    inbox, archive, out = tmp_path / "in", tmp_path / "old", str(tmp_path / "out")
    fill(inbox, "a.json", [record(1), '{"user": "cut off', record(2), ""])
    fill(inbox / "job", "b.json", ["not json", record(3), '{"number": "seven", "user": "x"}'])
    fill(inbox, "empty.json", [])
    make_folder(spark, str(archive))

    def run():
        stream = intake.stream_inbox(spark, str(inbox), str(archive), files_per_trigger=1, extra=EXTRA)
        intake.take_all(stream, out, str(archive))
        return intake.taken(stream, out), intake.dead_letters(stream, out)

    records, broken = run()
    assert sorted(r["number"] for r in records.collect()) == [1, 2, 3]
    assert records.filter("timestamp is null or event_time is null").count() == 0
    lines = {(r["file"].rsplit("/", 1)[1], r["broken"]) for r in broken.collect()}
    assert lines == {
        ("a.json", '{"user": "cut off'), ("b.json", "not json"), ("b.json", '{"number": "seven", "user": "x"}'),
    }
    # A file without a line waits for the next batch, if its batch was the last.
    left = {p.name for p in inbox.rglob("*.json")}
    assert left <= {"empty.json"}
    assert {p.name for p in archive.rglob("*.json")} == {"a.json", "b.json", "empty.json"} - left

    fill(inbox, "c.json", [record(4), record(1)])
    records, broken = run()
    assert sorted(r["number"] for r in records.collect()) == [1, 1, 2, 3, 4] and broken.count() == 3
    assert not list(inbox.rglob("*.json"))
    assert {p.name for p in archive.rglob("*.json")} == {"a.json", "b.json", "c.json", "empty.json"}


def test_progress_has_a_row_a_batch(spark, tmp_path):
    for i in range(3):
        fill(tmp_path / "in", f"{i}.json", [record(n) for n in range(i + 1)])
    stream = intake.stream_inbox(spark, str(tmp_path / "in"), files_per_trigger=1)
    with ProgressLog(spark, str(tmp_path / "log"), {"intake", "absent"}) as log:
        query = intake.take_in(stream, str(tmp_path / "out"), every=None, name="intake")
        other = sinks.append_table(stream, str(tmp_path / "other"), every=None, name="other")
        sinks.finish(query)
        sinks.finish(other)
        log.wait(query)
    rows = log.table().collect()
    assert sorted((r["batch"]) for r in rows) == [0, 1, 2]
    assert {r["query"] for r in rows} == {"intake"} and all(r["seconds"] > 0 and r["started"] for r in rows)
    # Each line is read for the records and once more for the broken ones.
    assert intake.taken(stream, str(tmp_path / "out")).count() == 6
