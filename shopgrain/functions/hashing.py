"""Seeded hashes of a row key: the random order behind splits and samples.

A hash depends on the row alone, so it does not change with partitioning, retries or cluster size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_hex(keys: Sequence[str], seed: int) -> Column:
    """32 lower-case hex digits from the key columns and the seed."""
    parts = [F.coalesce(F.col(key).cast("string"), F.lit("")) for key in keys]
    return F.md5(F.concat_ws(":", *parts, F.lit(str(seed))))


def hash_rank(keys: Sequence[str], seed: int) -> Column:
    """The first 13 hex digits as a whole number below 2**52, exact as a double."""
    return F.conv(F.substring(hash_hex(keys, seed), 1, 13), 16, 10).cast("double")
