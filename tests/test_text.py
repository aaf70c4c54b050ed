"""Cleaning chain, against the expected outputs of FIXTURES.md and against Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from plainspeak.functions import fixed_values as V
from plainspeak.functions import text as X
from plainspeak.plans.cleaning import clean_comments, normalise_comments

CASES = [
    ("Hello   @bob_1 World", "hello world"),
    ("@abcdefghijklmnopqrs hi", "pqrs hi"),
    ("@Nguyễn hi", "ễn hi"),
    ("#News today", "news today"),
    ("#đẹp #Hot tag", "#đẹp hot tag"),
    ("see http://x.y/z?q=1 now", "see now"),
    ("HTTP://A.b/c x", "http://a.b/c x"),
    ("www.site.com ok", "ok"),
    ("awww nice day", "a day"),
    ("ftp:///a b", "b"),
    ("foo@gmail.com hi", "foo.com hi"),
    ("mail me: a.b@c.org", "mail me: a.b.org"),
    ("x@-y.com", None),
    ("   ", None),
    ("\n", "\n"),
    ("a\tb", "a\tb"),
    ("w#ww.x y", "y"),
    (None, None),
]


def test_normalise_cases(spark):
    rows = [(i, text) for i, (text, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "id int, comment string")
    got = {r["id"]: r["comment_norm"] for r in normalise_comments(df).collect()}
    want = {i: out for i, (_, out) in enumerate(CASES) if out is not None}
    assert got == want


def test_guards_do_not_change_the_chain(spark):
    """The marker tests skip regular expressions only where they cannot match."""
    rng = random.Random(5)
    pieces = ["@", "#", "w", "ww", "www.", "http:", "//", "://", ".", " ", "  ", "ab", "é", "x1", "ftp", "\n", "-", "_"]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))) for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, t string")
    plain = F.col("t")
    for pattern, new in ((V.MENTION, ""), (V.HASHTAG, "$1"), (V.URL, ""), (V.EMAIL, ""), (" +", " ")):
        plain = F.regexp_replace(plain, pattern, new)
    plain = F.lower(F.trim(plain))
    assert df.filter(~X.normalise("t").eqNullSafe(plain)).count() == 0
    assert len({t for _, t in rows}) > 2000


def test_switches(spark):
    df = spark.createDataFrame([("@Nguyễn hi awww #đẹp foo@gmail.com",)], "t string")
    row = df.select(
        X.normalise("t", strict_unicode=True).alias("strict"),
        X.normalise("t", email_first=True).alias("mail"),
    ).first()
    assert row["strict"] == "hi awww đẹp foo.com"
    assert row["mail"] == "ễn hi ađẹp"


def test_emoji(spark):
    rows = [("\U0001f600\U0001f600",), ("a\U0001f680b",), ("\U0001f923",), ("❤️x",), ("plain",), (None,)]
    df = spark.createDataFrame(rows, "t string")
    assert [r[0] for r in df.select(X.strip_emoji("t")).collect()] == ["", "ab", "\U0001f923", "❤️x", "plain", None]
    assert [r[0] for r in df.select(X.strip_emoji("t", extended=True)).collect()] == ["", "ab", "", "x", "plain", None]


def test_words_like_python_split(spark):
    texts = ["a  b\tc", " lead", "trail ", "", "x y　z", "p\x1cq\x85r", " ", "một\r\nhai"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(X.words("t")).collect()] == [t.split() for t in texts]


def test_stop_words_and_preprocess(spark):
    df = spark.createDataFrame([("the Cat  sat\non THE mat \U0001f600",), ("the the",), ("",)], "t string")
    kept = [r[0] for r in df.select(X.drop_stop_words("t", ["the", "on"])).collect()]
    assert kept == ["Cat sat THE mat \U0001f600", "", ""]
    done = [r[0] for r in df.select(X.preprocess("t", ["the"])).collect()]
    assert done == ["cat sat on the mat ", "", ""]
    cased = df.select(X.preprocess("t", ["the"], lowercased=False)).first()[0]
    assert cased == "Cat sat on THE mat "


@pytest.mark.parametrize("size", [3, 40, 500])
def test_stop_word_list_sizes(spark, size):
    listed = [f"w{i}" for i in range(size)]
    df = spark.createDataFrame([(" ".join(f"w{i}" for i in range(600)),)], "t string")
    assert df.select(X.drop_stop_words("t", listed)).first()[0].split() == [f"w{i}" for i in range(size, 600)]


def test_vocabulary_words(spark):
    text = "don't stop, a_b-c!\tx\ny (z) \"q\" Ä"
    want = re.sub("[" + re.escape(V.VOCABULARY_SEPARATORS) + "]", " ", text).split(" ")
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(X.vocabulary_words("t")).first()[0] == [w for w in want if w]


def test_display_words(spark):
    text = "Xin chào, các-bạn! _ok_ 12% é"
    want = re.sub(r"[^\w\s]", "", text.lower()).split()
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(X.display_words("t")).first()[0] == want


def test_blank_clean_is_flagged(spark):
    df = spark.createDataFrame([("\U0001f600",), ("ok",)], "comment string")
    rows = {r["comment"]: r for r in clean_comments(df).collect()}
    assert rows["\U0001f600"]["comment_clean"] == "" and rows["\U0001f600"]["is_blank_clean"]
    assert not rows["ok"]["is_blank_clean"]


def test_cleaning_runs_once_and_without_python(spark):
    df = spark.createDataFrame([("a@b.c d",)], "comment string")
    plan = clean_comments(df, ["d"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    assert plan.count("lower(trim(") == 1
