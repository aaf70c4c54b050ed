"""Quality of texts by Bradley-Terry ranking.

A document's strength is linear in features of its text. Of a preference pair (a document labelled
good, one labelled bad) the good one wins with probability sigmoid(strength difference); the weights
minimise the logistic loss on the feature differences of such pairs. The threshold is a quantile of
the strengths of all labelled rows: the share of bad ones among them falls below it.

The fit of the weights takes at most ``fit_rows`` labelled rows (those with the smallest hash of their id),
so what reaches the driver has a bound; share and quantile are counted by Spark over every labelled row.
Every document is scored, from its whole text and nothing else.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, whole_text

FIT_ROWS = 12_000
#: The quantile is exact to so many parts of the labelled rows.
QUANTILE_PARTS = 1_000_000
#: Opponents of each row of the smaller class.
OPPONENTS = 24
L2 = 1e-3
#: A score at or above this is accepted; the threshold of the strengths gets exactly this score.
ACCEPT = 0.3

FEATURES = (
    "letters", "upper", "digits", "pipes", "exclamations", "symbols", "stops", "distinct", "stutter",
    "word_length", "log_words", "marked_words", "repeated_lines", "short_words",
)

_CLASS = np.zeros(256, np.int64)  # 0: rest, by byte of UTF-8
_CLASS[list(b" \t\n\v\f\r")] = 1
_CLASS[list(range(ord("a"), ord("z") + 1))] = 2
_CLASS[list(range(128, 256))] = 3
_CLASS[list(range(ord("A"), ord("Z") + 1))] = 4
_CLASS[list(range(ord("0"), ord("9") + 1))] = 5
_CLASS[ord("|")] = 6
_CLASS[ord("!")] = 7
_CLASS[list(b"#$%&*@^~=+<>_\\/{}[]")] = 8
_CLASS[list(b".,;:?")] = 9


def features(text: str) -> list[float]:
    """The features of one whole text, all zero where it has no word."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    bytes_ = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    kinds = np.bincount(_CLASS, weights=bytes_, minlength=10)
    seen = max(kinds.sum() - kinds[1], 1)
    ascii_letters = max(kinds[2] + kinds[4], 1)
    different = len(set(words))
    stutter = sum(map(eq, words, words[1:])) / n
    marked = sum(w[-1] in b"#$%&*@^~=+<>_\\/!" for w in words) / n
    lines = [x for x in data.split(b"\n") if x]
    return [
        (kinds[2] + kinds[3] + kinds[4]) / seen,
        kinds[4] / ascii_letters,
        kinds[5] / seen,
        min(kinds[6] / n, 1.0),
        min(kinds[7] / n, 2.0),
        min(kinds[8] / n, 4.0),
        min(kinds[9] / n, 2.0),
        math.log1p(different) / math.log1p(n),
        stutter,
        min(seen / n, 30.0) / 10,
        math.log1p(n) / 10,
        marked,
        1 - len(set(lines)) / len(lines),
        sum(len(w) == 1 for w in words) / n,
    ]


def held_out(doc_id: Column) -> Column:
    """Rows that no fit may see: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


# --- fit ----------------------------------------------------------------------------


@dataclass
class Model:
    """Strength = (features - mean) / scale . weight; score = sigmoid(strength - threshold + logit(ACCEPT))."""

    mean: np.ndarray = field(default_factory=lambda: np.zeros(len(FEATURES)))
    scale: np.ndarray = field(default_factory=lambda: np.ones(len(FEATURES)))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(len(FEATURES)))
    threshold: float = 0.0

    def strength(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weight

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.strength(x) - self.threshold + math.log(ACCEPT / (1 - ACCEPT))
        return np.where(z >= 0, 1 / (1 + np.exp(-np.abs(z))), 1 - 1 / (1 + np.exp(-np.abs(z))))


def fit_pairs(x: np.ndarray, good: np.ndarray, opponents: int = OPPONENTS, l2: float = L2, steps: int = 30) -> Model:
    """Bradley-Terry by Newton steps. With rows of one class only nothing is learned and all are accepted."""
    model = Model()
    if not len(x):
        return model
    model.mean, deviation = x.mean(axis=0), x.std(axis=0)
    model.scale = np.where(deviation > 1e-9, deviation, 1.0)
    z = (x - model.mean) / model.scale
    wins, losses = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(wins) or not len(losses):
        return model
    few, many = (losses, wins) if len(losses) <= len(wins) else (wins, losses)
    a = np.repeat(few, opponents)
    b = many[(np.arange(len(a)) * max(1, len(many) // max(1, min(len(many), len(a))))) % len(many)]
    d = z[a] - z[b] if few is wins else z[b] - z[a]
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))  # probability that the pair is lost
        gradient = l2 * w - d.T @ p / len(d)
        curvature = (d * (p * (1 - p))[:, None]).T @ d / len(d) + l2 * np.eye(len(w))
        step = np.linalg.solve(curvature, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    model.weight = w
    ranked = np.sort(model.strength(x))
    bad = len(losses)  # the quantile that the share of bad rows cuts off, between two rows
    model.threshold = float((ranked[bad - 1] + ranked[bad]) / 2)
    return model


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """From labelled rows that aren't held out. Null labels, ids and unlabelled rows are left out; of an id
    that is labelled good and bad, or repeated, all rows count."""
    usable = labels.select(F.col(id_col).alias("id"), F.col("quality").cast("int").alias("quality")).filter(
        "id IS NOT NULL AND quality IN (0, 1)"
    )
    chosen = usable.filter(~held_out(F.col("id"))).orderBy(F.xxhash64("id"), "id", "quality").limit(fit_rows)
    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    found = rows.join(F.broadcast(chosen), "id")  # at most fit_rows rows
    frame = _with_features(found.select("id", "text", "quality"), "quality").orderBy(F.xxhash64("id"), "quality").collect()
    x = np.array([r["features"] for r in frame]).reshape(-1, len(FEATURES))
    model = fit_pairs(x, np.array([r["quality"] == 1 for r in frame], bool))
    if model.weight.any():
        model.threshold = _threshold(rows, usable.filter(~held_out(F.col("id"))), model)
    return model


def _threshold(rows: DataFrame, labelled: DataFrame, model: Model) -> float:
    """The strength that the share of bad rows cuts off, between two rows, from all labelled ones."""
    ranked = keep(_by_text(rows, model.strength, "strength").join(labelled, "id").select("strength", "quality"), "quality-ranked")
    n, bad = ranked.agg(F.count(F.lit(1)), F.count_if(F.col("quality") == 0)).first()
    ends = F.array(F.lit((bad - 0.5) / n), F.lit((bad + 0.5) / n))
    return sum(ranked.agg(F.percentile_approx("strength", ends, QUANTILE_PARTS)).first()[0]) / 2


def _with_features(rows: DataFrame, extra: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column(extra), pa.array(found, pa.list_(pa.float64()))],
                names=["id", extra, "features"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, {extra} int, features array<double>")


# --- scores -------------------------------------------------------------------------


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, held_out, score (0 to 1), predicted (1 if score >= ACCEPT, else 0).

    Null texts count as empty ones, whose features are zero; a null id is not held out. Rows that repeat
    an id get a row each. An empty table gives an empty result. Other columns are ignored. No shuffle.
    """
    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    return _by_text(rows, model.score, "score").select(
        F.col("id").alias(id_col),
        held_out(F.col("id")).alias("held_out"),
        "score",
        (F.col("score") >= ACCEPT).cast("int").alias("predicted"),
    )


def _by_text(rows: DataFrame, value: Callable[[np.ndarray], np.ndarray], name: str) -> DataFrame:
    """``rows(id, text)`` to id and ``value`` of the text's features, as column ``name``."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column("text")]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(value(x))], names=["id", name])

    return rows.mapInArrow(run, f"id {kind}, {name} double")


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model accepts, all columns kept, in one pass."""
    schema, at = docs.schema, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py() or "") for t in batch.column(at)]).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(model.score(x) >= ACCEPT))

    return docs.mapInArrow(run, schema)
