"""Term weights as a table, for texts and vocabularies of any size.

Same numbers as the feature stages of ``plans.training`` (term count times
``ln((documents + 1) / (documents with the term + 1))``), without their vocabulary limit.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .blocks import rewrite_texts


_BREAKS = " \t\n\x0b\f\r"


def ml_words(text):
    """Lower case, split at each white-space character, empty words included, trailing
    empty ones dropped: what Spark ML's Tokenizer gives."""
    lowered = F.lower(F.col(text) if isinstance(text, str) else text)
    kept = F.rtrim(lowered, F.lit(_BREAKS))
    parts = F.split(kept, f"[{_BREAKS}]")
    return F.when(kept != "", parts).when(lowered == "", F.array(F.lit(""))).otherwise(
        F.array().cast("array<string>")
    )


def _counted(texts: list[list[str]], idf: dict[str, float]) -> list[tuple[str, int, float]]:
    return [(term, tf, idf[term]) for term, tf in Counter(w for words in texts for w in words).items()]


def term_weights(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, tf, tfidf. ``key`` is unique.

    Document frequencies come first, from the distinct terms of each text, combined in the map tasks; only
    they are stored. Texts stay whole (``blocks.rewrite_texts``): a block asks for the weights of its distinct
    terms, and terms are counted in the document's row. ``docs`` is read more than once, so costly cleaning
    is best stored before.
    """
    terms = F.explode(F.array_distinct(ml_words(text))).alias("term")
    frequency = stored(docs.select(terms).groupBy("term").agg(F.count("*").alias("n")), "document-frequency")
    documents = docs.count()
    frequency = frequency.withColumn("idf", F.ln(F.lit(float(documents + 1)) / (F.col("n") + 1)))
    weighed = rewrite_texts(
        docs, key, text, ml_words(text), frequency, "idf", set, _counted,
        "array<struct<term:string,tf:bigint,idf:double>>", "weighed", word="term",
    ).select(key, F.inline("weighed"))
    return weighed.select(key, "term", "tf", (F.col("tf") * F.col("idf")).alias("tfidf"))
