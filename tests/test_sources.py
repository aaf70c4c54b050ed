import json

from pyspark.sql import functions as F

from plainspeak.plans.cleaning import normalise_comments
from plainspeak.sources import artifacts, comments, corpus, lists

RECORDS = [
    {"user": "u1", "comment": "hi", "timestamp": "1657594741.5"},
    {"user": "u2", "comment": "", "timestamp": "bad"},
    {"user": "u1", "comment": "yo", "timestamp": "1657594801.5"},
]


def write_records(folder):
    folder.mkdir()
    for i, record in enumerate(RECORDS):
        (folder / f"{i}.json").write_text(json.dumps(record, ensure_ascii=False))
    (folder / "9.json").write_text("{broken")
    return str(folder)


def test_captured_comments(spark, tmp_path):
    raw = comments.read_comments(spark, write_records(tmp_path / "in"))
    rows = sorted(normalise_comments(raw).select("user", "comment_norm", "timestamp").collect())
    assert [tuple(r) for r in rows] == [("u1", "hi", 1657594741.5), ("u1", "yo", 1657594801.5)]


def test_comment_sink_round_trip(spark, tmp_path):
    raw = comments.read_comments(spark, write_records(tmp_path / "in")).filter("comment != ''")
    comments.write_comments(raw.withColumn("comment", F.lit("chào")), str(tmp_path / "out"), 1)
    files = list((tmp_path / "out").glob("*.json"))
    assert len(files) == 2 and all(len(f.read_text().splitlines()) == 1 for f in files)
    assert "chào" in files[0].read_text()
    back = comments.read_comments(spark, str(tmp_path / "out"))
    assert sorted(r["timestamp"] for r in back.collect()) == [1657594741.5, 1657594801.5]


def test_guard_and_cap(spark):
    df = spark.createDataFrame(
        [(1, " a ", "x "), (2, "\t", "x"), (3, "b", " \n"), (4, "c", None)],
        "comment_id int, user string, comment string",
    )
    assert [tuple(r) for r in comments.guard_blank(df).collect()] == [(1, "a", "x")]
    assert [r[0] for r in comments.intake_cap(df, 2).collect()] == [1, 2]


def test_labelled_corpus(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text('free_text,label_id\n"a ""q"" b",0\n"line1\nline2",1\nok,2\nbad,x\n')
    rows = corpus.read_corpus(spark, str(path)).collect()
    assert [tuple(r) for r in rows] == [('a "q" b', 0), ("line1\nline2", 1), ("ok", 2), ("bad", None)]
    assert corpus.read_corpus(spark, str(path), multi_line=False).count() == 5
    assert corpus.keep_valid_labels(corpus.read_corpus(spark, str(path))).count() == 3


def test_union_forms(spark):
    a = spark.createDataFrame([("x", 0)], "free_text string, label_id int")
    b = spark.createDataFrame([(1, "y")], "label_id int, free_text string")
    tagged = corpus.combine(corpus.tag_split(a, "Train"), corpus.tag_split(b, "Dev"), corpus.tag_split(a, "Test"))
    assert sorted((r["free_text"], r["set"], r["counter"]) for r in tagged.collect()) == [
        ("x", "Test", 1), ("x", "Train", 1), ("y", "Dev", 1),
    ]
    assert corpus.combine_by_position(a, a).count() == 2


def test_lists(spark, tmp_path):
    (tmp_path / "stop.txt").write_text('"và"\nlà\nlà\n"a"b"\n')
    assert sorted(r[0] for r in lists.read_stop_words(spark, str(tmp_path / "stop.txt")).collect()) == ['a"b', "là", "và"]
    (tmp_path / "v.vec").write_text("2 3\nxin 1 2 3.5 \nchào 0 -1 1e-2\n")
    rows = sorted(tuple(r) for r in lists.read_word_vectors(spark, str(tmp_path / "v.vec"), 3).collect())
    assert [r[0] for r in rows] == ["chào", "xin"] and rows[1][1] == [1.0, 2.0, 3.5]
    ids = spark.createDataFrame([(11,), (12,)], "id int")
    lists.append_ids(ids, str(tmp_path / "ids"))
    lists.append_ids(ids.limit(1), str(tmp_path / "ids"))
    assert lists.read_ids(spark, str(tmp_path / "ids")).count() == 3


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([("a", 2, 1)], "word string, n bigint, idx bigint")
    artifacts.save_table(df, str(tmp_path / "t"))
    artifacts.save_table(df, str(tmp_path / "t"))
    assert artifacts.load_table(spark, str(tmp_path / "t")).collect() == df.collect()
