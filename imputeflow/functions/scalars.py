"""Scalar expressions shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The studied missing rates and the guard added to denominators.
MISSING_RATES = (0.05, 0.10, 0.20, 0.30, 0.40, 0.50, 0.60, 0.70, 0.80)
GUARD = 1e-8
# Fixed values: (upper rate, rounds) of the chained imputers, and the rounds beyond.
ROUNDS_BY_RATE = ((0.10, 5), (0.30, 10), (0.50, 15))
ROUNDS_BEYOND = 20


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def total(cols) -> Column:
    return reduce(lambda a, b: a + b, cols)


def nan_to_null(c: Column | str) -> Column:
    c = as_col(c)
    return F.when(~F.isnan(c), c)


def sentinel_to_null(c: Column | str, sentinel: str = "?") -> Column:
    """Text column with a sentinel for missing, as a number."""
    c = as_col(c)
    return F.when(c != F.lit(sentinel), c).try_cast("double")


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.least(x, F.lit(hi)), F.lit(lo))


def min_max(x: Column, lo: float, hi: float) -> Column:
    return (x - F.lit(lo)) / F.lit(hi - lo + GUARD)


def half_even_count(rate: float, n: int) -> int:
    """``rate * n`` rounded half to even; Python's own rounding does that."""
    return int(round(rate * n))


def closest_rate(rate: Column, bins=MISSING_RATES) -> Column:
    """The nearest bin; the lower one wins a tie. Without bins the rate itself."""
    if not bins:
        return rate
    table = F.array(*[F.lit(float(b)) for b in sorted(bins)])
    ranked = F.transform(table, lambda b: F.struct(F.abs(b - rate).alias("d"), b.alias("b")))
    return F.array_min(ranked).getField("b")


def closest_rate_value(rate: float, bins=MISSING_RATES) -> float:
    if not bins:
        return float(rate)
    return float(min(sorted(bins), key=lambda b: (abs(b - rate), b)))


def rounds_for_rate(rate: Column) -> Column:
    out = None
    for upper, rounds in ROUNDS_BY_RATE:
        out = F.when(rate <= upper, rounds) if out is None else out.when(rate <= upper, rounds)
    return out.otherwise(ROUNDS_BEYOND)


def rounds_for_rate_value(rate: float) -> int:
    return next((n for upper, n in ROUNDS_BY_RATE if rate <= upper), ROUNDS_BEYOND)
