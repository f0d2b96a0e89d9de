"""What the operators of this package share: words, materialized projections and bounded dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters that separate words, and a run of them.
SPACE_CHARS = " \t\n\u000b\u000c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
# The letters that are lower-cased; others are left as they are.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """The words of a text in order; none for a null text."""
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    return (
        F.when(text.isNull() | (trimmed == ""), F.array().cast("array<string>"))
        .otherwise(F.split(trimmed, SPACE_RUN))
    )


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later steps may read many times, each computed once for a row.

    A later lambda that names a plain projected column may have its expression inlined and so evaluated for each
    element; through a generator it is not.
    """
    kept = [F.col(name) for name in df.columns if name not in columns]
    return df.select(F.inline(F.array(F.struct(*kept, *[c.alias(name) for name, c in columns.items()]))))


def bound(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, as an argument of a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)
