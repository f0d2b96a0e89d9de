"""Left lookup joins: every left row is kept and meets at most a few right rows.

The right side of such a join is usually an aggregate or a deduplicated table and so already partitioned by the
key. Joined as it is, a hot key of the left side would stay in one task: adaptive execution splits a skewed
partition only where both inputs of the join come straight from a shuffle. Joining on the key and a hash of it
asks for a partitioning that neither side has, which costs one more shuffle of the side with one row per key
and lets a hot key be split over tasks.

No side is forced into a broadcast. Spark compares the measured size of the right side with
``spark.sql.autoBroadcastJoinThreshold``, from file statistics at planning and from shuffle statistics at run time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPREAD = "_spread"


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str],
    left_suffix: str = "",
    right_suffix: str = "_right",
) -> DataFrame:
    """``left`` with the columns of ``right`` attached by equal keys. Columns both sides share get the suffixes."""
    keys = [on] if isinstance(on, str) else list(on)
    shared = (set(left.columns) & set(right.columns)) - set(keys)
    if shared and left_suffix == right_suffix:
        raise ValueError(f"suffixes must differ for shared columns {sorted(shared)}")
    if shared and left_suffix:
        left = left.withColumnsRenamed({name: name + left_suffix for name in shared})
    if shared and right_suffix:
        right = right.withColumnsRenamed({name: name + right_suffix for name in shared})
    spread = F.xxhash64(*keys)
    joined = left.withColumn(SPREAD, spread).join(right.withColumn(SPREAD, spread), [*keys, SPREAD], "left")
    return joined.drop(SPREAD)
