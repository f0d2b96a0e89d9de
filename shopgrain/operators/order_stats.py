"""Exact quantiles and rank cuts without collecting a group in one task.

``percentile`` keeps every distinct value of a group in one buffer. Here equal values become one row with a count. A group
of at most ``SMALL`` distinct values is ranked as it is. A sketch cuts the values of a larger one into ``CELLS`` cells of about
equal size, the cells' totals tell in which one a rank falls, and only the values of that cell are ranked. The same plan
serves any number of groups and rows; nothing passes through the driver, and infinite values are values like others.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .aggregates import double_or_null

CELLS = 256
SMALL = 1 << 16

Stage = Callable[[DataFrame], DataFrame]


def group_key(by: Sequence[str]) -> Column:
    """The group as one value. As part of a struct a missing key equals another missing key."""
    return F.struct(*by) if by else F.struct(F.lit(0).alias("_all"))


def _values_at_ranks(
    df: DataFrame, value: str, by: Sequence[str], ranks: Sequence[Column], stage: Stage | None
) -> DataFrame:
    """(``_key``, ``_i``, ``_n``, ``_value``): the value at each 0-based rank, given as expressions of ``_n``."""
    rows = df.select(group_key(by).alias("_key"), double_or_null(value).alias("_x")).where(F.col("_x").isNotNull())
    counts = rows.groupBy("_key", "_x").agg(F.count(F.lit(1)).alias("_c"))
    counts = stage(counts) if stage else counts
    sizes = counts.groupBy("_key").agg(F.sum("_c").alias("_n"), F.count("_c").alias("_values"))
    large = sizes.where(F.col("_values") > SMALL).select("_key", "_n")  # at most one in SMALL of the counted values
    wanted = F.posexplode(F.array(*[rank.cast("bigint") for rank in ranks])).alias("_i", "_rank")
    group = Window.partitionBy("_key")
    # No semi or anti join: Spark would move it below the counting and count once for each use.
    tagged = counts.join(F.broadcast(large.select("_key", F.lit(True).alias("_large"))), "_key", "left")
    small = tagged.where(F.col("_large").isNull()).select(
        "_key", "_x", "_c", _running("_c", group.orderBy("_x")).alias("_to"), F.sum("_c").over(group).alias("_n")
    ).select("*", wanted)
    inside, hits = _cut(counts, large, large.select("_key", "_n", wanted))
    cell = ["_key", "_cell"]
    ends = inside.withColumn("_to", _running("_c", Window.partitionBy(*cell).orderBy("_x")))
    found = [
        ranked.where((F.col("_rank") < F.col("_to")) & (F.col("_rank") >= F.col("_to") - F.col("_c")))
        .select("_key", "_i", "_n", F.col("_x").alias("_value"))
        for ranked in (small, ends.join(hits, cell))
    ]
    return found[0].unionByName(found[1])


def _running(name: str, order: WindowSpec) -> Column:
    return F.sum(name).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))


def _cut(counts: DataFrame, large: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the ``large`` groups, values of the cells that hold a wanted rank, and the ranks counted from the start of their cell."""
    fractions = [i / CELLS for i in range(1, CELLS)]
    # Read with their counts, as by the other steps, so that all share one shuffle.
    values = counts.join(F.broadcast(large), "_key").select("_key", F.when(F.col("_c") > 0, F.col("_x")).alias("_x"))
    edges = values.groupBy("_key").agg(F.percentile_approx("_x", fractions, 4 * CELLS).alias("_edges"))
    placed = counts.join(F.broadcast(edges), "_key").select("_key", "_x", "_c", _edges_below(F.col("_edges"), F.col("_x")).alias("_cell"))
    upward = Window.partitionBy("_key").orderBy("_cell")  # at most CELLS rows
    totals = placed.groupBy("_key", "_cell").agg(F.sum("_c").alias("_total")).withColumn("_end", _running("_total", upward))
    start = F.col("_end") - F.col("_total")
    hits = wanted.join(totals, "_key").where((F.col("_rank") >= start) & (F.col("_rank") < F.col("_end"))).select(
        "_key", "_cell", "_n", "_i", (F.col("_rank") - start).alias("_rank")
    )
    chosen = hits.select("_key", "_cell").distinct()  # at most CELLS of a group
    return placed.join(F.broadcast(chosen), ["_key", "_cell"]), hits


def _edges_below(edges: Column, x: Column) -> Column:
    """How many of the ascending ``edges``, fewer than ``CELLS``, are below ``x``, by halving steps."""
    steps = [CELLS >> k for k in range(1, CELLS.bit_length())]

    def step(below: Column, size: Column) -> Column:
        return below + F.when(F.get(edges, below + size - 1) < x, size).otherwise(0)

    return F.aggregate(F.array(*[F.lit(k) for k in steps]), F.lit(0), step)


def exact_quantiles(
    df: DataFrame, value: str, fractions: Mapping[str, float], by: Sequence[str] = (), stage: Stage | None = None
) -> DataFrame:
    """Linearly interpolated quantiles, one column per entry of ``fractions``, one row per group.

    A group without any value gives no row. ``stage`` may write the counted values, which are read several times.
    """
    by = list(by)
    positions = [F.lit(float(q)) * (F.col("_n") - 1) for q in fractions.values()]
    found = _values_at_ranks(df, value, by, [f(p) for p in positions for f in (F.floor, F.ceil)], stage)

    def at(i):
        return F.max(F.when(F.col("_i") == i, F.col("_value")))

    def quantile(k: int, position: Column) -> Column:
        below, above = at(2 * k), at(2 * k + 1)
        between = below + (above - below) * (position - F.floor(position))
        # Equal neighbours, infinite ones included, need no arithmetic.
        return F.when(below == above, below).otherwise(between)

    per_group = found.groupBy("_key", "_n").agg(*[
        quantile(k, position).alias(name) for k, (name, position) in enumerate(zip(fractions, positions))
    ])
    if by:
        return per_group.select("_key.*", *fractions)
    return per_group.agg(*[F.max(name).alias(name) for name in fractions])


def values_at_shares(
    df: DataFrame, value: str, parts: int, by: Sequence[str] = (), stage: Stage | None = None
) -> DataFrame:
    """Per group, the values at the ends of the first ``parts - 1`` of so many equal parts, in rows (``by``, ``part``, ``value``).

    The end of part ``i`` is the value of the row number ``ceil(i * n / parts)`` in order.
    """
    ranks = [F.floor((F.lit(i) * F.col("_n") + (parts - 1)) / parts) - 1 for i in range(1, parts)]
    found = _values_at_ranks(df, value, by, [F.greatest(r, F.lit(0)) for r in ranks], stage)
    return found.select(*([F.col("_key.*")] if by else []), (F.col("_i") + 1).alias("part"), F.col("_value").alias("value"))


def at_or_above_quantile(df: DataFrame, value: str, fraction: float) -> DataFrame:
    """Rows whose ``value`` is at least the given quantile of all rows. ``df`` is read several times."""
    cut = exact_quantiles(df, value, {"cut": fraction}).scalar()
    return df.where(F.col(value) >= cut)


def lowest_share(
    df: DataFrame, value: str, by: Sequence[str], fraction: float, stage: Stage | None = None
) -> DataFrame:
    """Per group (``_key``), the largest value among its lowest ``ceil(fraction * n)`` rows, as column ``cut``."""
    rank = F.ceil(F.lit(float(fraction)) * F.col("_n")) - 1
    return _values_at_ranks(df, value, by, [rank], stage).select("_key", F.col("_value").alias("cut"))
