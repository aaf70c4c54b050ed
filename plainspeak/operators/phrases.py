"""Compound words: learn pairs that belong together, join them with an underscore.

A pair is kept when it occurs at least ``min_count`` times and

    (n_pair - discount) * n_words / (n_a * n_b) > threshold

the scoring of Mikolov et al., "Distributed Representations of Words and Phrases and
their Compositionality" (2013).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import stored
from .blocks import rewrite_texts
from .counts import ALL, count_terms
from .lookup import look_up


def fit_phrases(
    docs: DataFrame, text: str, min_count: int = 5, threshold: float = 10.0, discount: int = 5
) -> DataFrame:
    """a, b, n, score. Words and pairs are counted in one pass, in whole texts (``counts.count_terms``); what is frequent
    is stored before the word counts are looked up, and those look-ups are safe for frequent words.
    ``docs`` is read twice (size, counts), so costly cleaning is best stored before."""
    # A word of a kept pair occurs at least min_count times itself.
    counts = stored(count_terms(docs, text, pairs=True, least=min_count), "term-counts")
    total = counts.filter(F.col("term") == ALL).agg(F.sum("n")).first()[0] or 0
    is_pair = F.contains("term", F.lit(" "))
    pairs = counts.filter(is_pair).select(
        F.substring_index("term", " ", 1).alias("a"), F.substring_index("term", " ", -1).alias("b"), "n"
    )
    words = counts.filter(~is_pair & (F.col("term") != ALL))
    first = words.select(F.col("term").alias("word"), "n", F.col("n").alias("n_a"))
    second = words.select(F.col("term").alias("word"), "n", F.col("n").alias("n_b"))
    counted = look_up(pairs, first, ["n_a"], key="a", salt_from=["a", "b"])
    counted = look_up(counted, second, ["n_b"], key="b", salt_from=["a", "b"])
    score = (
        (F.col("n") - discount).cast("double")
        * F.lit(float(total))
        / (F.col("n_a").cast("double") * F.col("n_b").cast("double"))
    )
    return counted.select("a", "b", "n", score.alias("score")).filter(F.col("score") > threshold)


def _pairs(words: list[str]) -> set[str]:
    return set(map("{} {}".format, words, words[1:]))


def _joined(texts: list[list[str]], linked: dict[str, bool]) -> str:
    """One text (the texts of a repeated key word by word beside one another) with its linked pairs joined."""
    words = [
        (i, w, t[i + 1] if i + 1 < len(t) else None) for t in texts for i, w in enumerate(t)
    ]
    if len(texts) > 1:
        words.sort(key=lambda x: x[0])
    pieces, last_break, taken = [], -1, False
    for i, word, after in words:
        link = after is not None and f"{word} {after}" in linked
        if not link:
            last_break = i
        # Place within the run of linked pairs: 1, 2, 3, ...; odd places are joined.
        joined = link and (i - last_break) % 2 == 1
        if not taken:
            pieces.append((i, f"{word}_{after}" if joined else word))
        taken = joined
    if len(texts) > 1:
        pieces.sort(key=lambda x: (x[0], x[1].encode("utf-8", "surrogatepass")))
    return " ".join([x for _, x in pieces])


def join_phrases(
    docs: DataFrame, lexicon: DataFrame, key: str, text: str, budget: int | None = None
) -> DataFrame:
    """Columns: key, text, with lexicon pairs joined by ``_``, left to right, a word in at
    most one pair; other words separated by one space. ``key`` is unique.

    In a run of consecutive lexicon pairs every second one is joined, starting with the
    first. Texts stay whole (``blocks.rewrite_texts``): a block asks for its distinct pairs once, and
    only pairs of the lexicon come back. ``docs`` and ``lexicon`` are read more than once. A lexicon of at most
    ``budget`` bytes is broadcast.
    """
    table = lexicon.select(F.concat_ws(" ", "a", "b").alias("word"), "n", F.lit(True).alias("linked"))
    return rewrite_texts(docs, key, text, X.words(text), table, "linked", _pairs, _joined, "string", text, budget=budget)
