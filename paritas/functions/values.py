"""Null, NaN and threshold rules.

The four comparisons differ on purpose: labels and predictions are positive
*from* the threshold on, group membership and human ratings only *above* it.
Spark sorts NaN above every number, so NaN has to be taken out before it is
compared.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zero_if_missing(value: Column) -> Column:
    """Double with null and NaN read as 0."""
    value = value.cast("double")
    return F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0))


def binary_label(target: Column, threshold: float = 0.5) -> Column:
    """1 when the score reaches the threshold; a missing score counts as 0."""
    return (zero_if_missing(target) >= F.lit(float(threshold))).cast("int")


def binary_prediction(score: Column, threshold: float = 0.5) -> Column:
    """1 when the predicted score reaches the threshold; null stays null."""
    return (score.cast("double") >= F.lit(float(threshold))).cast("int")


def above(value: Column, cut: float) -> Column:
    """True when strictly above the cut; null and NaN are not."""
    value = value.cast("double")
    return F.coalesce((value > F.lit(float(cut))) & ~F.isnan(value), F.lit(False))


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def checked_score(score: Column) -> Column:
    """The score as double. A missing score fails the query: no rank exists
    for it, and leaving the row out would silently change every rate."""
    score = score.cast("double")
    return F.when(
        score.isNull() | F.isnan(score),
        F.raise_error(F.lit("prediction score is null or NaN")).cast("double"),
    ).otherwise(score)


def checked_label(label: Column) -> Column:
    """The label as 0 or 1. Anything else fails the query: counted as it is, it would
    silently change every metric."""
    value = label.cast("double")
    return F.when(value.isin(0.0, 1.0), value.cast("long")).otherwise(
        F.raise_error(F.lit("label is neither 0 nor 1")).cast("long")
    )
