"""Grouping helpers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import nan_to_null


def keep_known_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Rows whose group key is present: a missing key forms no group. The test reaches a Parquet scan."""
    return df.where(reduce(and_, [F.col(key).isNotNull() for key in keys]))


def count_by(df: DataFrame, key: str, count_name: str) -> DataFrame:
    """Frequency of each present value, most frequent first."""
    counts = keep_known_keys(df.select(key), key).groupBy(key).agg(F.count(F.lit(1)).alias(count_name))
    return counts.orderBy(F.col(count_name).desc(), key)


def fill_domain(
    aggregate: DataFrame, domain: DataFrame, on: str | Sequence[str], defaults: Mapping[str, float | int]
) -> DataFrame:
    """One row per key of ``domain``, with ``defaults`` where the aggregate has no such group.

    Counts and sums default to zero; columns without a default, such as means, stay missing.
    """
    keys = [on] if isinstance(on, str) else list(on)
    return domain.select(*keys).distinct().join(aggregate, keys, "left").fillna(dict(defaults))


def double_or_null(name: str):
    return nan_to_null(F.col(name).cast("double"))
