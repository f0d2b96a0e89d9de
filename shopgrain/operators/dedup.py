"""One row per key.

``row_number() = 1`` is planned with a group limit before the shuffle: each task sends at most one row per
key, so a key that holds a third of all rows does not reach a single task whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_row", F.row_number().over(window)).where("_row = 1").drop("_row")


def keep_first(df: DataFrame, keys: Sequence[str], tie_break: Sequence[Column] | None = None) -> DataFrame:
    """The first row per key; missing keys count as equal to each other.

    A distributed table has no file order, so "first" follows ``tie_break``: by default all other columns in
    ascending order, which gives the same row in every run.
    """
    order = tie_break or [F.col(name) for name in df.columns if name not in keys] or [F.col(keys[0])]
    return _first_by(df, keys, order)


def keep_latest(df: DataFrame, keys: Sequence[str], ts: str, tie_break: Sequence[Column] | None = None) -> DataFrame:
    """The row with the latest ``ts`` per key; a row without a time counts as latest."""
    rest = tie_break or [F.col(n).desc_nulls_last() for n in df.columns if n not in keys and n != ts]
    return _first_by(df, keys, [F.col(ts).desc_nulls_first(), *rest])
