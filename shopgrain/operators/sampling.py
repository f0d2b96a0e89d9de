"""Splits and samples in the order of a seeded row hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hash_hex, hash_rank
from .joins import lookup_join
from .order_stats import Stage, group_key, lowest_share


def _check_fraction(fraction: float) -> None:
    if not 0 <= fraction <= 1:
        raise ValueError(f"a fraction lies between 0 and 1, not at {fraction}")


def hash_split(
    df: DataFrame, keys: Sequence[str], test_fraction: float = 0.2, seed: int = 42, column: str = "split"
) -> DataFrame:
    """``test`` for about ``test_fraction`` of the rows, else ``train``. One narrow projection, no shuffle."""
    _check_fraction(test_fraction)
    number = F.conv(F.substring(hash_hex(keys, seed), 1, 8), 16, 10).cast("bigint")
    is_test = number < int(test_fraction * 2**32)
    return df.withColumn(column, F.when(is_test, "test").otherwise("train"))


def stratified_split(
    df: DataFrame,
    keys: Sequence[str],
    label: str,
    test_fraction: float = 0.2,
    seed: int = 42,
    column: str = "split",
    stage: Stage | None = None,
) -> DataFrame:
    """``test`` for exactly ``ceil(test_fraction * n)`` rows of each label, given unique keys.

    The cut is an exact order statistic of the hash per label, so no label is sorted in one task. ``df`` is read
    several times; pass a stored or staged table.
    """
    _check_fraction(test_fraction)
    hashed = df.withColumn("_hash", hash_rank(keys, seed))
    cuts = lowest_share(hashed, "_hash", [label], test_fraction, stage)
    joined = lookup_join(hashed.withColumn("_key", group_key([label])), cuts, "_key")
    is_test = F.col("_hash") <= F.col("cut")
    return joined.withColumn(column, F.when(is_test, "test").otherwise("train")).drop("_hash", "_key", "cut")


def exact_sample(df: DataFrame, n: int, keys: Sequence[str], seed: int = 0, stage: Stage | None = None) -> DataFrame:
    """``min(n, rows)`` rows: those with the smallest hash, further ordered by the keys.

    At most about ``2 n`` rows reach the final sort: a hash limit is derived from the row count, which reads no columns,
    and it is lifted if, against all odds (a key shared by very many rows), fewer than ``n`` rows pass it. ``stage``
    may write the rows below the limit, so that the table is scanned once.
    """
    hashed = df.withColumn("_order", hash_hex(keys, seed))
    share = (2.0 * n + 1000.0) / max(df.count(), 1)
    near = hashed
    if share < 1:
        near = hashed.where(F.col("_order") < format(int(share * 2**32), "08x"))
        near = stage(near) if stage else near
        if near.count() < n:
            near = hashed
    rest = [F.col(name) for name in df.columns if name not in keys]
    return near.orderBy("_order", *keys, *rest).limit(n).drop("_order")
