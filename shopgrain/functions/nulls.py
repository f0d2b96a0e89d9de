"""One missing value, NULL, and the arithmetic that goes with it.

Sources normalise NaN to NULL, because Spark orders NaN above every number and lets it poison sums.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan_to_null(value: Column) -> Column:
    return F.nanvl(value, F.lit(None).cast("double"))


def finite_or_null(value: Column) -> Column:
    """NaN and both infinities become NULL."""
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def zero_if_null(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def false_if_null(condition: Column) -> Column:
    """A comparison with a missing operand counts as not satisfied."""
    return F.coalesce(condition, F.lit(False))


def sum_or_zero(value: Column) -> Column:
    """A group without any value sums to zero, not to NULL."""
    return F.coalesce(F.sum(value), F.lit(0.0))


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """NULL instead of an error or an infinity for a zero or missing denominator."""
    return F.try_divide(numerator, denominator)
