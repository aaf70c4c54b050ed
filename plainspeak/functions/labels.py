"""Label and score functions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def parse_label(label: Column | str) -> Column:
    """Class 0, 1 or 2 from text or number; anything else is NULL."""
    text = _column(label).cast("string")
    return F.when(text.rlike(r"^\s*[012]\s*$"), F.trim(F.regexp_replace(text, r"\s", ""))).cast("int")


def valid_label(label: Column | str) -> Column:
    return parse_label(label).isin(0, 1, 2)


def replace_values(value: Column | str, mapping: Mapping) -> Column:
    """Listed values are replaced, unlisted ones pass through as text."""
    value = _column(value)
    out = None
    for key, name in mapping.items():
        condition = value == F.lit(key)
        out = F.when(condition, F.lit(name)) if out is None else out.when(condition, F.lit(name))
    return value.cast("string") if out is None else out.otherwise(value.cast("string"))


def label_name(label: Column | str) -> Column:
    return replace_values(label, V.LABEL_NAMES)


def label_capitals(label: Column | str) -> Column:
    return replace_values(label, V.LABEL_CAPITALS)


def label_status(name: Column | str) -> Column:
    """Colour of a label name; NULL for unknown names."""
    name = _column(name)
    out = F.lit(None).cast("string")
    for label, colour in V.STATUS_COLOURS.items():
        out = F.when(name == label, F.lit(colour)).otherwise(out)
    return out


def one_hot(label: Column | str, classes: int = 3) -> Column:
    """1.0 at the label's place; NULL label gives NULL."""
    label = _column(label)
    hot = F.transform(
        F.sequence(F.lit(0), F.lit(classes - 1)),
        lambda i: F.when(i == label, F.lit(1.0)).otherwise(F.lit(0.0)),
    )
    return F.when(label.isNotNull(), hot)


def argmax(scores: Column | str) -> Column:
    """Index of the largest score, the first on ties; NULL or empty gives NULL.

    Scores and maximum are cast to float alike, so equality is exact.
    """
    as_float = _column(scores).cast("array<float>")
    return (F.array_position(as_float, F.array_max(as_float)) - 1).cast("int")
