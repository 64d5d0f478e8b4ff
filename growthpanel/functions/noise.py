"""Standard-normal noise and quantiles as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the text of ``parts`` only, never from partitioning: 52 bits of its MD5."""
    digits = F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def repeatable_normal(seed: int, *parts: Column) -> Column:
    """N(0, 1) by Box-Muller on two hashes of ``parts``; ``randn`` would change with the partitioning."""
    radius = F.sqrt(F.lit(-2.0) * F.log(_uniform(F.lit(seed), F.lit("radius"), *parts)))
    angle = F.lit(2.0 * math.pi) * _uniform(F.lit(seed), F.lit("angle"), *parts)
    return radius * F.cos(angle)


# Coefficients of Acklam's published rational approximation to the normal quantile.
_CENTRE_TOP = (
    -3.969683028665376e01,
    2.209460984245205e02,
    -2.759285104469687e02,
    1.383577518672690e02,
    -3.066479806614716e01,
    2.506628277459239e00,
)
_CENTRE_BOTTOM = (
    -5.447609879822406e01,
    1.615858368580409e02,
    -1.556989798598866e02,
    6.680131188771972e01,
    -1.328068155288572e01,
    1.0,
)
_TAIL_TOP = (
    -7.784894002430293e-03,
    -3.223964580411365e-01,
    -2.400758277161838e00,
    -2.549732539343734e00,
    4.374664141464968e00,
    2.938163982698783e00,
)
_TAIL_BOTTOM = (
    7.784695709041462e-03,
    3.224671290700398e-01,
    2.445134137142996e00,
    3.754408661907416e00,
    1.0,
)
_TAIL_STARTS = 0.02425


def _polynomial(x: Column, coefficients: tuple[float, ...]) -> Column:
    value = F.lit(coefficients[0])
    for c in coefficients[1:]:
        value = value * x + F.lit(c)
    return value


def normal_quantile(p: Column) -> Column:
    """Inverse of the standard normal distribution, relative error below 1.2e-9."""
    centred = p - F.lit(0.5)
    squared = centred * centred
    centre = centred * _polynomial(squared, _CENTRE_TOP) / _polynomial(squared, _CENTRE_BOTTOM)
    depth = F.sqrt(F.lit(-2.0) * F.log(F.least(p, F.lit(1.0) - p)))
    tail = _polynomial(depth, _TAIL_TOP) / _polynomial(depth, _TAIL_BOTTOM)
    return (
        F.when((p <= 0.0) | (p >= 1.0), F.lit(None).cast("double"))
        .when(p < _TAIL_STARTS, tail)
        .when(p > 1.0 - _TAIL_STARTS, -tail)
        .otherwise(centre)
    )
