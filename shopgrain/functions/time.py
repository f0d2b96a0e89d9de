"""Elapsed days and calendar truncation on zone-free timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000.0


def days_between(start: Column, end: Column) -> Column:
    """Fractional days from ``start`` to ``end``; NULL if either is missing."""
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(MICROS_PER_DAY)


def month_start(ts: Column) -> Column:
    """Midnight on the first day of the month, still zone-free."""
    return F.trunc(ts.cast("date"), "month").cast("timestamp_ntz")
