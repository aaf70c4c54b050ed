"""Language of web pages by Bayesian fusion of evidence.

- Text: naive Bayes over hashed letter trigrams of the page's main text, learned from labelled documents.
- Declared language: how often a page of language l declares d, counted over all pages.
- Address: languages of the pages of the same host, smoothed towards those of hosts with the same
  address suffix, those towards all pages; a page's own evidence is left out of its prior.

Counts come from grouped aggregation of each page's text evidence (as probabilities). A host that
holds a third of all pages is one row a map task, and its prior is broadcast back.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import page_text  # noqa: F401  the functions below are shipped by name, without the module
from .common import keep, left_join_by_key, whole_text
from .page_text import analyse, host_of

BUCKETS = 1 << 14
#: Labelled documents the text model is learned from, at most (those with the smallest hash of the id).
FIT_ROWS = 6_000
#: Weight of one trigram: neighbouring trigrams overlap, so they aren't three independent facts.
TEMPER = 0.3
#: Pages that a prior from the next level up counts for.
STRENGTH = 5.0

_DECLARED = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-zA-Z]+)", re.I)


def trigrams(text: str) -> np.ndarray:
    """Counts of hashed letter trigrams; what isn't a letter counts as one space."""
    letters = "".join(c if c.isalpha() else " " for c in text.lower()) if not text.isalpha() else text.lower()
    code = np.frombuffer(f" {' '.join(letters.split())} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(code) < 3:
        return np.zeros(BUCKETS)
    h = (code[:-2] * np.uint32(0x9E3779B1)) ^ (code[1:-1] * np.uint32(0x85EBCA77)) ^ (code[2:] * np.uint32(0xC2B2AE3D))
    return np.bincount((h ^ (h >> np.uint32(15))) & np.uint32(BUCKETS - 1), minlength=BUCKETS).astype(float)


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[list[str], np.ndarray]:
    """(languages, log probability of each trigram in each) from documents with a language. Counts are added
    up in the tasks; the driver gets one row a language and trigram."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    sample = labelled.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    rows = labelled.join(F.broadcast(sample.distinct()), "doc_id").select("lang", whole_text("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                sums[lang] = sums.get(lang, 0) + trigrams(text.as_py())
        for lang, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])],
                names=["lang", "bucket", "n"],
            )

    counted = rows.mapInArrow(run, "lang string, bucket int, n double").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counted.collect()  # at most BUCKETS rows a language
    languages = sorted({r["lang"] for r in found})
    table = np.full((BUCKETS, max(1, len(languages))), 0.5)
    for r in found:
        table[r["bucket"], languages.index(r["lang"])] += r["n"]
    return languages, np.log(table / table.sum(axis=0))


def _evidence(languages: list[str], model: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, suffixes, declared, text = [], [], [], []
            for page, url in zip(batch.column("html"), batch.column("url")):
                markup = page.as_py() or ""
                host = host_of(url.as_py())
                hosts.append(host)
                suffixes.append(host.rpartition(".")[2])
                found = _DECLARED.search(markup)
                declared.append(found[1].lower() if found else "")
                body = " ".join(t for t, _ in analyse(markup)[2])
                score = TEMPER * (trigrams(body) @ model) if body else np.zeros(len(languages))
                score = score - score.max()
                text.append((score - math.log(np.exp(score).sum())).tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("url"), pa.array(hosts, pa.string()), pa.array(suffixes, pa.string()),
                 pa.array(declared, pa.string()), pa.array(text, pa.list_(pa.float64()))],
                names=["id", "url", "host", "suffix", "declared", "text"],
            )

    return run


def _sums(name: str, size: int) -> Column:
    """The sum of arrays, element by element; combined in the map tasks."""
    return F.array(*[F.sum(F.col(name)[i]) for i in range(size)])


def _exp(column: Column) -> Column:
    return F.transform(column, lambda x: F.exp(x))


def identify(
    pages: DataFrame, languages: list[str], model: np.ndarray, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """One row per row of ``pages``: id, url, lang, probability, text_lang (from the text alone), declared.

    Null or empty html and pages without text are decided by the other evidence. Without a usable address
    the host is "". Equal probabilities go to the language that comes first in the alphabet. Rows that
    repeat an id, or have none, get a row each. Without a language to choose from, or without pages, the
    result is empty. Other columns are ignored.
    """
    rows = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")
    )
    kind = rows.schema["id"].dataType.simpleString()
    if not languages:
        return rows.limit(0).selectExpr(
            f"id AS {id_col}", f"url AS {url_col}", "'' AS lang", "0.0D AS probability", "'' AS text_lang", "'' AS declared"
        )
    size = len(languages)
    schema = f"id {kind}, url string, host string, suffix string, declared string, text array<double>"
    seen = keep(rows.mapInArrow(_evidence(languages, model), schema), "language-evidence")
    soft = seen.withColumn("p", _exp(F.col("text")))

    hosts = keep(
        soft.groupBy("host").agg(F.first("suffix").alias("suffix"), F.count(F.lit(1)).alias("n"), _sums("p", size).alias("h")),
        "language-hosts",
    )
    suffixes = hosts.groupBy("suffix").agg(_sums("h", size).alias("s"), F.sum("n").alias("m"))
    everything = hosts.agg(_sums("h", size).alias("g"), F.sum("n").alias("t")).first()
    total = [float(x or 0.0) for x in everything["g"]]
    # How often a page of language l declares d, one page of doubt for each pair.
    said = soft.groupBy("declared").agg(F.count(F.lit(1)).alias("k"), _sums("p", size).alias("d"))
    kinds = said.count()
    said = keep(
        said.select(
            "declared",
            "k",
            F.array(*[F.log((F.col("d")[i] + 1.0) / F.lit(total[i] + kinds)) for i in range(size)]).alias("says"),
        ),
        "language-declared",
    )
    # Keyed by suffix too: a host has one.
    priors = keep(hosts.join(suffixes, "suffix"), "language-priors").drop("suffix")
    placed = keep(left_join_by_key(soft, priors, "host", "n"), "language-placed")
    told = left_join_by_key(placed, said, "declared", "k")

    def prior(i: int) -> Column:
        own = F.col("p")[i]
        count = sum(total)
        world = (F.lit(total[i]) - own + 1.0) / F.lit(max(count - 1.0, 0.0) + size)
        suffix = (F.col("s")[i] - own + STRENGTH * world) / (F.col("m") - 1 + STRENGTH)
        return F.greatest((F.col("h")[i] - own + STRENGTH * suffix) / (F.col("n") - 1 + STRENGTH), F.lit(1e-9))

    joint = F.array(*[F.col("text")[i] + F.col("says")[i] + F.log(prior(i)) for i in range(size)])
    told = told.withColumn("joint", joint).withColumn("most", F.array_max("joint"))
    names = F.array(*[F.lit(x) for x in languages])

    def winner(scores: Column) -> Column:
        return F.get(names, F.array_position(scores, F.array_max(scores)).cast("int") - 1)

    all_of = F.aggregate("joint", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("most")))
    return told.select(
        F.col("id").alias(id_col),
        F.col("url").alias(url_col),
        winner(F.col("joint")).alias("lang"),
        (1 / all_of).alias("probability"),
        winner(F.col("text")).alias("text_lang"),
        "declared",
    )
