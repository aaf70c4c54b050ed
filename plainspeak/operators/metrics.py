"""Quality of predictions against labels; classes are 0, 1, 2."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLASSES = (0, 1, 2)


def confusion_matrix(
    pairs: DataFrame, label: str = "label_id", prediction: str = "prediction"
) -> DataFrame:
    """A row for every class (true), a count for every class (predicted). Classes are 0, 1, 2 and
    whatever else occurs as label or as prediction. Rows without a label or a prediction aren't counted."""
    counts = (
        pairs.select(F.col(label).cast("int").alias("own"), F.col(prediction).cast("int").alias("said"))
        .filter("own IS NOT NULL AND said IS NOT NULL")
        .groupBy("own", "said")
        .count()
    )
    found = {(r[0], r[1]): r[2] for r in counts.collect()}  # one row a pair of classes
    classes = sorted({*CLASSES, *[c for pair in found for c in pair]})
    names = [f"predicted_{c}".replace("-", "minus_") for c in classes]
    rows = [(c, *[found.get((c, said), 0) for said in classes]) for c in classes]
    return pairs.sparkSession.createDataFrame(rows, ", ".join([f"`{label}` int", *[f"{n} long" for n in names]])).coalesce(1)


def _hit(right: Column, label: str) -> Column:
    """1 or 0 where there is a label: a missing prediction is a miss."""
    return F.when(F.col(label).isNotNull(), F.coalesce(right, F.lit(False)).cast("int"))


def accuracy(pairs: DataFrame, label: str = "label_id", prediction: str = "prediction") -> DataFrame:
    """Hits over all rows with a label."""
    return pairs.agg(F.avg(_hit(F.col(label) == F.col(prediction), label)).alias("accuracy"))


def _tallies(label: str, prediction: str) -> list[Column]:
    y, p = F.col(label), F.col(prediction)
    out = []
    for c in CLASSES:
        out += [
            F.count_if((y == c) & (p == c)).alias(f"hit_{c}"),
            F.count_if(y == c).alias(f"true_{c}"),
            F.count_if(p == c).alias(f"said_{c}"),
        ]
    return out


def f1_micro(pairs: DataFrame, label: str = "label_id", prediction: str = "prediction") -> DataFrame:
    t = pairs.agg(*_tallies(label, prediction))
    total = lambda kind: reduce(lambda a, b: a + b, [F.col(f"{kind}_{c}") for c in CLASSES])
    value = 2 * total("hit") / F.nullif(total("true") + total("said"), F.lit(0))
    return t.select(value.alias("f1_micro"))


def f1_macro(pairs: DataFrame, label: str = "label_id", prediction: str = "prediction") -> DataFrame:
    """Plain mean over the classes that occur as label or as prediction; a class without
    a hit counts as 0. (The evaluator's "f1" is weighted by class size.)"""
    t = pairs.agg(*_tallies(label, prediction))
    seen = [F.col(f"true_{c}") + F.col(f"said_{c}") for c in CLASSES]
    scores = [
        F.when(s > 0, 2 * F.col(f"hit_{c}") / s).otherwise(F.lit(0.0)) for c, s in zip(CLASSES, seen)
    ]
    classes = reduce(lambda a, b: a + b, [(s > 0).cast("int") for s in seen])
    value = reduce(lambda a, b: a + b, scores) / F.nullif(classes, F.lit(0))
    return t.select(value.alias("f1_macro"))


def log_loss(
    pairs: DataFrame, label: str = "label_id", scores: str = "scores", epsilon: float = 1e-7
) -> DataFrame:
    """Mean cross-entropy of the label's score, and accuracy of the arg-max, over all rows with a label.
    Rows without a score for their label count as ``epsilon`` and as a miss."""
    from ..functions.labels import argmax

    own = F.get(F.col(scores), F.col(label).cast("int")).cast("double")
    loss = F.when(F.col(label).isNotNull(), -F.ln(F.greatest(own, F.lit(epsilon))))
    return pairs.agg(
        F.avg(loss).alias("loss"), F.avg(_hit(argmax(scores) == F.col(label), label)).alias("accuracy")
    )


def quality(pairs: DataFrame, label: str = "label_id", prediction: str = "prediction") -> DataFrame:
    """accuracy, f1_micro, f1_macro in one row, one pass over the pairs."""
    t = pairs.agg(*_tallies(label, prediction), F.count_if(F.col(label).isNotNull()).alias("rows"))
    total = lambda kind: reduce(lambda a, b: a + b, [F.col(f"{kind}_{c}") for c in CLASSES])
    seen = [F.col(f"true_{c}") + F.col(f"said_{c}") for c in CLASSES]
    parts = [
        F.when(s > 0, 2 * F.col(f"hit_{c}") / s).otherwise(F.lit(0.0)) for c, s in zip(CLASSES, seen)
    ]
    classes = reduce(lambda a, b: a + b, [(s > 0).cast("int") for s in seen])
    return t.select(
        (total("hit") / F.nullif(F.col("rows"), F.lit(0))).alias("accuracy"),
        (2 * total("hit") / F.nullif(total("true") + total("said"), F.lit(0))).alias("f1_micro"),
        (reduce(lambda a, b: a + b, parts) / F.nullif(classes, F.lit(0))).alias("f1_macro"),
    )
