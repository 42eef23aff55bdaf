"""Numeric expressions that stay exact or NULL where plain arithmetic would raise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE = "decimal(38,0)"
INFINITY = float("inf")


def finite(c: Column) -> Column:
    """NaN and both infinities become NULL."""
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(INFINITY)), c)


def sum_of_squares_sd(n: Column, total: Column, squares: Column) -> Column:
    """Population standard deviation from integer sums: ``sqrt(n*sum(x^2) - sum(x)^2) / n``.

    Integer arithmetic makes the result independent of row order. The 64-bit form is
    tried first; where it would overflow the same formula runs in wide decimals.
    """
    short = squares.try_cast("bigint")
    narrow = F.try_subtract(F.try_multiply(n, short), F.try_multiply(total, total))
    n_, total_, squares_ = n.cast(WIDE), total.cast(WIDE), squares.cast(WIDE)
    wide = n_ * squares_ - total_ * total_
    return F.sqrt(F.coalesce(narrow.cast("double"), wide.cast("double"))) / n


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation; NULL where either side is constant."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def standardized(x: Column, mean: float | None, sd: float | None) -> Column:
    """``(x - mean) / sd``; a constant column maps to 0."""
    x = x.cast("double")
    if mean is None:
        return x
    return (x - F.lit(mean)) / F.lit(sd if sd else 1.0)


def min_max_scaled(x: Column, low: float | None, high: float | None) -> Column:
    """``(x - low) / (high - low)``; a constant column maps to 0."""
    x = x.cast("double")
    if low is None:
        return x
    return (x - F.lit(low)) / F.lit((high - low) or 1.0)
