"""From raw documents to packed sequences: five stages, each over all that the one before kept.

quality classifier -> exact dedup -> near dedup -> mixing to target weights -> packing
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plainspeak.llm import exact, mixing, packing, quality, simhash
from plainspeak.llm.common import keep, table
from plainspeak.llm.queries import MIX_SHARE, MIX_WEIGHTS, domain_of


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact.drop_exact_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: fingerprints of four-word shingles, four bits apart at most."""
    return simhash.drop_near_duplicates(docs, width=simhash.WIDTH, budget=simhash.BUDGET)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the token-prefix of each source."""
    return mixing.chosen(docs, domain_of("source"), MIX_WEIGHTS, MIX_SHARE)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("simhash", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: No SQL: fitted model, XXH64 fingerprints and byte-pair ids have none.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
