"""Model outputs to probabilities, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(logit: Column) -> Column:
    """1 / (1 + e^-x), in the form whose exponent is never positive."""
    logit = logit.cast("double")
    tail = F.exp(-F.abs(logit))
    return F.when(logit >= 0, F.lit(1.0) / (F.lit(1.0) + tail)).otherwise(
        tail / (F.lit(1.0) + tail)
    )


def softmax_of_two(negative: Column, positive: Column) -> Column:
    """Softmax share of the second of two logits; only their difference counts."""
    return sigmoid(positive.cast("double") - negative.cast("double"))


def logits_to_score(logits: Column) -> Column:
    """P(positive) from an array of two class logits or of a single logit."""
    return F.when(
        F.size(logits) == 2, softmax_of_two(F.get(logits, F.lit(0)), F.get(logits, F.lit(1)))
    ).otherwise(sigmoid(F.get(logits, F.lit(0))))


def zero_shot_score(logits: Column, yes: int, no: int) -> Column:
    """P(yes) against P(no), from two entries of a vocabulary's logits."""
    return softmax_of_two(F.get(logits, F.lit(no)), F.get(logits, F.lit(yes)))
