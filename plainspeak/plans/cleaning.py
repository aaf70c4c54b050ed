"""Cleaning: one DataFrame function for batch and stream."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.frames import compute_once
from ..operators.phrases import join_phrases


def normalise_comments(
    comments: DataFrame,
    text: str = "comment",
    strict_unicode: bool = False,
    email_first: bool = False,
) -> DataFrame:
    """Add ``comment_norm`` and keep the rows where it holds something. NULL texts go,
    texts of other white space than spaces stay."""
    normal = X.normalise(text, strict_unicode, email_first)
    return compute_once(comments, "comment_norm", normal).filter(F.col("comment_norm") != "")


def clean_comments(
    comments: DataFrame,
    stop_words: Iterable[str] = (),
    text: str = "comment",
    strict_unicode: bool = False,
    email_first: bool = False,
    extended_emoji: bool = False,
) -> DataFrame:
    """``normalise_comments``, then ``comment_clean`` without stop words and emoji.
    ``comment_clean`` may be empty: ``is_blank_clean`` says so."""
    normal = normalise_comments(comments, text, strict_unicode, email_first)
    cleaned = X.preprocess("comment_norm", stop_words, extended_emoji=extended_emoji)
    return compute_once(normal, "comment_clean", cleaned).withColumn(
        "is_blank_clean", F.col("comment_clean") == ""
    )


def clean_with_phrases(
    comments: DataFrame,
    lexicon: DataFrame,
    key: str,
    stop_words: Iterable[str] = (),
    text: str = "comment",
    strict_unicode: bool = False,
    email_first: bool = False,
    extended_emoji: bool = False,
) -> DataFrame:
    """``clean_comments`` with compound words joined (``operators.phrases``) before stop
    words and emoji are removed. ``key`` is unique. The rows are read twice, so store
    ``normalise_comments`` and pass that: rows with ``comment_norm`` aren't normalised again."""
    normal = comments
    if "comment_norm" not in comments.columns:
        normal = normalise_comments(comments, text, strict_unicode, email_first)
    joined = join_phrases(normal, lexicon, key, "comment_norm").withColumnRenamed(
        "comment_norm", "comment_joined"
    )
    cleaned = X.preprocess("comment_joined", stop_words, extended_emoji=extended_emoji)
    return (
        compute_once(normal.join(joined, key), "comment_clean", cleaned)
        .drop("comment_joined")
        .withColumn("is_blank_clean", F.col("comment_clean") == "")
    )


def clean_corpus(
    corpus: DataFrame,
    stop_words: Iterable[str] = (),
    text: str = "free_text",
    label: str = "label_id",
    drop_blank: bool = True,
) -> DataFrame:
    """Labelled texts ready for fitting: ``text_clean`` and a valid label."""
    from ..sources.corpus import keep_valid_labels

    cleaned = clean_comments(keep_valid_labels(corpus, label), stop_words, text)
    out = cleaned.drop("comment_norm").withColumnRenamed("comment_clean", "text_clean")
    return out.filter(~F.col("is_blank_clean")) if drop_blank else out
