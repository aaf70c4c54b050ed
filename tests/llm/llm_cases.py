"""Rows that every operator has to take: nulls, empty and long texts, ties, repeats, clashing columns."""

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "id string, content string, digest string, fp long, n long, leaf string, rest string, rank int, task int, mask int"
)
LONG = "wörd another  word\n" * 20_000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog again and again", "en", "src0"),
    (2, "the quick brown fox  jumps over the lazy dog again and again", "en", "src0"),
    (3, "The quick brown fox\njumps over the lazy dog again and again", "en", "src1"),
    (4, None, None, None),
    (5, "", "de", "src2"),
    (6, " \t\n", "de", ""),
    (7, LONG, "fr", "src3"),
    (8, LONG, "fr", "src3"),
    (9, "one", "en", "src4"),
    (9, "one", "en", "src4"),
    (9, "another text of the same id", "en", "src4"),
    (None, "one", "en", "src4"),
    (None, None, "en", None),
    (None, "only here", "en", "src5"),
    (10, "𝒳 naïve ﬁ 日本 | | !! $$$ ### token = \"abcdef123\" mail a.b@c.de +49 171 2345678", "es", "src6"),
]
CLASH = ("x", "y", "z", 1, 2, "l", "r", 3, 4, 5)


def rows(spark):
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), *CLASH) for r in ROWS], SCHEMA)


def none(spark):
    return spark.createDataFrame([], SCHEMA)
