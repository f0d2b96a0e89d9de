"""Coercions that never fail: what cannot be read becomes NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nulls import nan_to_null

# The tokens that a CSV scan reads as missing.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
    "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def text_or_null(value: Column) -> Column:
    return F.when(~value.isin(*MISSING_TOKENS), value)


def timestamp_or_null(value: Column) -> Column:
    return value.try_cast("timestamp_ntz")


def number_or_null(value: Column, dtype: str = "double") -> Column:
    """A number, or NULL for text that is none; a type suffix as in ``1.5d`` does not make a number."""
    if dtype == "bigint":
        return value.try_cast("bigint")
    number = nan_to_null(value.try_cast("double"))
    number = F.when(~value.cast("string").rlike(r"[0-9.][dDfF]\s*$"), number)
    return number if dtype == "double" else number.try_cast(dtype)
