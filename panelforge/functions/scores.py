"""Logistic scores and log odds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def logit(p: Column, edge: float = 1e-5) -> Column:
    q = F.least(F.lit(1 - edge), F.greatest(F.lit(edge), p))
    return F.ln(q / (1 - q))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logistic_score(features: list[Column], means: list[float], scales: list[float], weights: list[float], bias: float) -> Column:
    """Sigmoid of the weighted standardised features."""
    total = F.lit(bias)
    for x, m, s, w in zip(features, means, scales, weights):
        total = total + (x - m) / s * w
    return sigmoid(total)


def reading_confidence(length: Column, stall: Column) -> Column:
    """Confidence of a length reading after ``stall`` bins without growth (fixed coefficients)."""
    return sigmoid(F.lit(-0.41) - 0.63 * F.log1p(stall) + 0.50 * F.log1p(F.greatest(length, F.lit(0.0))))
