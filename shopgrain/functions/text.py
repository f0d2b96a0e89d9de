"""Labels and number formats of the KPI tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def padded_label(prefix: str, number: Column, width: int = 2) -> Column:
    """``C`` and 7 give ``C07``; a number longer than ``width`` is kept whole."""
    digits = number.cast("string")
    padded = F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits)
    return F.concat(F.lit(prefix), padded)


def thousands(value: Column, places: int = 0) -> Column:
    """Comma-grouped number with fixed decimals."""
    return F.format_number(value, places)


def decimals(value: Column, places: int = 2) -> Column:
    """Fixed decimals without grouping."""
    return F.replace(F.format_number(value, places), F.lit(","), F.lit(""))


def percent(share: Column, places: int = 1) -> Column:
    return F.concat(decimals(share * 100, places), F.lit("%"))
