import datetime as dt

from pyspark.sql import functions as F

from plainspeak.functions import labels, links, times


def test_argmax(spark):
    rows = [([0.2, 0.5, 0.5],), (None,), ([],), ([float("nan"), 1.0],), ([0.1, 0.2, 0.7],)]
    df = spark.createDataFrame(rows, "s array<double>")
    assert [r[0] for r in df.select(labels.argmax("s")).collect()] == [1, None, None, 0, 2]


def test_parse_label(spark):
    rows = [("0",), (" 2 ",), ("1.0",), ("x",), ("3",), (None,), ("1\n",)]
    df = spark.createDataFrame(rows, "l string")
    assert [r[0] for r in df.select(labels.parse_label("l")).collect()] == [0, 2, None, None, None, None, 1]


def test_names_status_one_hot(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (7,), (None,)], "l int")
    got = df.select(
        labels.label_name("l").alias("n"),
        labels.label_status(labels.label_name("l")).alias("s"),
        labels.one_hot("l").alias("h"),
    ).collect()
    assert [r["n"] for r in got] == ["Clean", "Offensive", "Hate", "7", None]
    assert [r["s"] for r in got] == ["green", "orange", "red", None, None]
    assert [r["h"] for r in got] == [[1, 0, 0], [0, 1, 0], [0, 0, 1], [0, 0, 0], None]


def test_times(spark):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    stamp = 1657594741.757672
    df = spark.createDataFrame([(str(stamp),), ("bad",), (None,), ("NaN",)], "t string")
    row, bad, none, nan = df.select(
        times.parse_epoch("t").alias("e"),
        times.event_time(times.parse_epoch("t")).alias("at"),
        times.minute_text(times.parse_epoch("t")).alias("m"),
        times.clock_text(times.parse_epoch("t")).alias("c"),
        times.date_text(times.parse_epoch("t")).alias("d"),
    ).collect()
    at = dt.datetime.fromtimestamp(stamp, dt.timezone.utc)
    assert row["e"] == stamp
    assert (row["m"], row["c"], row["d"]) == (
        at.strftime("%H:%M %d-%m-%Y"), at.strftime("%H:%M:%S"), at.strftime("%d-%m-%Y"),
    )
    assert list(bad) == [None] * 5 and list(none) == [None] * 5
    assert nan["at"] is None


def test_capture_epoch_is_now(spark):
    got = spark.range(1).select(times.capture_epoch()).first()[0]
    assert abs(got - dt.datetime.now().timestamp()) < 60


def test_links(spark):
    rows = [
        ("https://h.example/page.one?x=1",),
        ("https://h.example",),
        ("https://h.example/sharer.php?sid=77&u=2",),
        ("https://h.example/comment/replies/?ctoken=12_34&c=1",),
    ]
    df = spark.createDataFrame(rows, "l string")
    got = df.select(
        links.page_id("l").alias("page"),
        links.post_id("l").alias("post"),
        links.comment_token("l").alias("token"),
        links.comment_number(links.comment_token("l")).alias("number"),
    ).collect()
    assert [r["page"] for r in got] == ["page.one", None, "sharer.php", "comment"]
    assert [r["post"] for r in got] == [None, None, "77", None]
    assert got[3]["token"] == "12_34" and got[3]["number"] == "34"


def test_absolute_link_and_search_terms(spark):
    df = spark.createDataFrame(
        [("/a?b", "https://h.example:8/x/y?z"), ("http://o.example/p", "https://h.example/")], "h string, u string"
    )
    assert [r[0] for r in df.select(links.absolute_link("h", "u")).collect()] == [
        "https://h.example:8/a?b", "http://o.example/p",
    ]
    assert spark.range(1).select(links.search_terms(F.lit(" tin  tức "))).first()[0] == "tin+tức"
