"""Scalar expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def d(x: float) -> Column:
    return F.lit(float(x))


def ratio(a: Column, b: Column, otherwise: float = 0.0) -> Column:
    """a / b, and `otherwise` where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), d(otherwise))


def soft_confidence(value: Column, threshold: float, spread: float, sign: int) -> Column:
    """0.5 at the threshold, towards 1 on the side of sign, clamped to [0, 1]."""
    raw = sign * (value - d(threshold)) / d(max(spread, 1e-9))
    return F.least(d(1), F.greatest(d(0), d(0.5) + d(0.5) * F.tanh(d(3) * raw)))


def logistic(raw: Column) -> Column:
    """1 / (1 + exp(-raw)), which is 0.5 for sums that miss 0 by a last place; exp(raw) where exp(-raw) would overflow."""
    return F.when(raw < -700, F.exp(raw)).otherwise(1 / (1 + F.exp(-raw)))


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < d(float("inf")))


def round6(c: Column) -> Column:
    """Half away from zero at six decimals."""
    return F.round(c, 6)


def all_of(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts)
