"""Scalar expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def return_to_probability(r: Column) -> Column:
    """A predicted return as a probability of going up."""
    return sigmoid(r * 100)


def score_to_probability(v: Column) -> Column:
    """A score fitted on 0/1 labels as a probability."""
    return sigmoid((v - 0.5) * 10)


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def minmax_normalise(v: Column, low: float, high: float) -> Column:
    return (v - low) / (high - low)


def direction_label(p: Column, threshold: float = 0.5) -> Column:
    return F.when(p > threshold, 1).otherwise(-1)


def nan_to_null(c: Column) -> Column:
    """NaN and both infinities become NULL."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def uniform_hash(seed: int, key: Column) -> Column:
    """A repeatable number in [0, 1) for each key."""
    head = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8)
    return F.conv(head, 16, 10).cast("bigint") / F.lit(4294967296.0)


def json_encode(**values: Column) -> Column:
    """The values under their names as one JSON object; arrays, matrices and maps stay nested, NULLs stay as null."""
    return F.to_json(F.struct(*(c.alias(n) for n, c in values.items())), {"ignoreNullFields": "false"})


def experiment_id(at: Column) -> Column:
    return F.date_format(at, "yyyyMMdd_HHmmss")


def polynomial(x: Column, coefficients: list[float]) -> Column:
    """Highest power first."""
    return reduce(lambda acc, c: acc * x + c, coefficients[1:], F.lit(coefficients[0]))


# Coefficients of the published rational approximation of the inverse normal
# distribution (Acklam); relative error below 1.2e-9.
CENTRE_TOP = [-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239]
CENTRE_BOTTOM = [-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0]
TAIL_TOP = [-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783]
TAIL_BOTTOM = [0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0]
TAIL = 0.02425


def inverse_normal(p: Column) -> Column:
    """Quantile of the standard normal distribution for 0 < p < 1."""
    edge = F.sqrt(-2 * F.ln(F.least(p, 1 - p)))
    tail = polynomial(edge, TAIL_TOP) / polynomial(edge, TAIL_BOTTOM)
    q = p - 0.5
    centre = polynomial(q * q, CENTRE_TOP) * q / polynomial(q * q, CENTRE_BOTTOM)
    return F.when(p < TAIL, tail).when(p > 1 - TAIL, -tail).otherwise(centre)
