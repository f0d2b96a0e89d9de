"""Typing, deduplication and key checks of the input tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import nan_to_null
from ..operators import keep_first, keep_known_keys, keep_latest
from ..schemas import IDENTIFIER_COLUMNS, PRIMARY_KEYS, REQUIRED_COLUMNS, TABLE_COLUMNS, columns_of_type
from ..sources import with_declared_types


def coerce_timestamps(df: DataFrame, table: str) -> DataFrame:
    """Declared timestamp columns as TIMESTAMP_NTZ; what cannot be read is NULL."""
    return with_declared_types(df, {name: "timestamp_ntz" for name in columns_of_type(table, "timestamp_ntz")})


def coerce_amounts(df: DataFrame, table: str) -> DataFrame:
    """Declared number columns as DOUBLE; NaN and what cannot be read are NULL."""
    names = [name for name in columns_of_type(table, "double") if name in df.columns]
    typed = with_declared_types(df, dict.fromkeys(names, "double"))
    return typed.withColumns({name: nan_to_null(F.col(name)) for name in names})


def cast_identifiers(df: DataFrame, table: str, dtype: str = "string") -> DataFrame:
    """Key and state columns in one type. Dictionary encoding is left to the storage format."""
    names = [name for name in IDENTIFIER_COLUMNS.get(table, []) if name in df.columns]
    return df.withColumns({name: F.col(name).cast(dtype) for name in names})


def latest_review_per_order(reviews: DataFrame) -> DataFrame:
    """The latest answered review per order; one without an answer time counts as latest."""
    if "review_answer_timestamp" not in reviews.columns:
        return reviews
    return keep_latest(reviews, ["order_id"], "review_answer_timestamp")


def drop_incomplete(df: DataFrame, table: str) -> DataFrame:
    """Rows with all required keys present."""
    return keep_known_keys(df, *REQUIRED_COLUMNS[table])


def clean_tables(
    tables: Mapping[str, DataFrame], identifier_type: str | None = None
) -> dict[str, DataFrame]:
    """All tables typed, deduplicated and free of rows without keys, in this order.

    Keys keep the type the source gives them; ``identifier_type`` forces one for sources that disagree.
    """
    cleaned = {}
    for name, rows in tables.items():
        rows = coerce_amounts(coerce_timestamps(rows, name), name) if name in TABLE_COLUMNS else rows
        if identifier_type:
            rows = cast_identifiers(rows, name, identifier_type)
        if name in PRIMARY_KEYS:
            rows = keep_first(rows, PRIMARY_KEYS[name])
        if name == "reviews":
            rows = latest_review_per_order(rows)
        if name in REQUIRED_COLUMNS:
            rows = drop_incomplete(rows, name)
        cleaned[name] = rows
    return cleaned
