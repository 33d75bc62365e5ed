"""Vector functions as Column expressions over array<float>/array<double>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Distances and score sums closer than this many decimals are ties, resolved by
# id or rank.  It makes the order independent of summation order.
TIE_DECIMALS = 9


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def l2_distance(a: Column, b: Column) -> Column:
    diff = F.zip_with(
        a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x - y
    )
    return F.sqrt(_sum(F.transform(diff, lambda d: d * d)))


def l2_norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(v.cast("array<double>"), lambda x: x * x)))


def normalise(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    norm = l2_norm(v)
    return F.transform(
        v.cast("array<double>"), lambda x: F.when(norm > 0, x / norm).otherwise(x)
    )


def score(distance: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + distance)
