"""Work in proportion to the text: one long text must not hold a task."""

import time

from plainspeak.llm import page_text, pii, queries, secret_scan


def seconds(run):
    begin = time.time()
    run()
    return time.time() - begin


def test_blanks_and_dots():
    assert seconds(lambda: pii.disguised("x @ y" + " " * 1_000_000, [[], [], [], []])) < 5
    assert seconds(lambda: pii.disguised("a dot " * 100_000 + "x@y.com", [[], [], [], []])) < 10


def test_dots_to_the_left_of_an_address():
    for text, want in (
        ("a dot b dot c@x.org", "a.b.c@x.org"), ("a dot b (dot) c [at] x dot org", "a.b.c@x.org"), ("a dot dot b@x.org", "a dot.b@x.org"),
        ("no dot here, a dot b@x.org", "no dot here, a.b@x.org"),
    ):
        assert pii.transduced(text).text == want, text


def test_nested_elements():
    for opening in ("<div>", "<div class='menu'>", "<ul><li>", "<b>"):
        assert seconds(lambda o=opening: page_text.analyse(o * 40_000 + "x")) < 10
    assert seconds(lambda: page_text.analyse("<div>" * 20_000 + "</p></span>" * 20_000 + "x")) < 10


def test_many_secrets_in_one_text(spark):
    text = "token=abcdef123 " * 20_000
    frame = spark.createDataFrame([(1, text), (2, "token=abcdef123 x")], "doc_id long, text string")
    begin = time.time()
    found = {r["doc_id"]: r["found"] for r in secret_scan.find_secrets(frame).collect()}
    assert time.time() - begin < 40
    assert [s["start"] for s in found[1] if s["k"] == 0] == [16 * i for i in range(20_000)]
    assert len([s for s in found[2] if s["k"] == 0]) == 1 and "op8_secrets" in queries.QUERIES
