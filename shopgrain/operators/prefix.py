"""Running sums and row numbers over a whole table without one task that sees all of it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Stage = Callable[[DataFrame], DataFrame]


def _in_ranges(df: DataFrame, order_by: Sequence[str], stage: Stage) -> DataFrame:
    """The rows dealt to ranges of ``order_by`` and written, with the number of their range in ``_bucket``.

    Spark cuts the ranges from a sample and joins small ones by their size, so their number follows the data.
    """
    ranged = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    return stage(ranged.withColumn("_bucket", F.spark_partition_id()))


def _in_cells(df: DataFrame, order_by: str, buckets: int) -> DataFrame:
    """The rows with the number of their cell of a sketch in ``_bucket``."""
    fractions = [i / buckets for i in range(1, buckets)]
    edges = df.agg(F.percentile_approx(order_by, fractions, 4 * buckets).alias("edges")).scalar()
    return df.withColumn("_edges", edges).withColumn(
        "_bucket", F.size(F.filter("_edges", lambda edge: edge < F.col(order_by)))
    )


def cumulative_before(
    df: DataFrame, order_by: str, sums: Sequence[str], buckets: int = 256, stage: Stage | None = None
) -> DataFrame:
    """Adds ``<name>_before``: the sum of ``name`` over all rows with a smaller ``order_by``.

    ``order_by`` holds distinct numbers. With ``stage``, which writes the rows, they are cut into as many ranges as their
    size asks for; without it, a sketch cuts them into ``buckets`` cells. The totals of whole buckets are summed over one
    row per bucket, and running sums stay inside one.
    """
    placed = _in_ranges(df, [order_by], stage) if stage else _in_cells(df, order_by, buckets)
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_bucket")
        .agg(*[F.sum(name).alias(f"_total_{name}") for name in sums])
        .select("_bucket", *[
            F.coalesce(F.sum(f"_total_{name}").over(earlier), F.lit(0)).alias(f"_offset_{name}") for name in sums
        ])
    )
    inside = Window.partitionBy("_bucket").orderBy(order_by).rowsBetween(Window.unboundedPreceding, -1)
    # ``offsets`` has one row per bucket.
    return placed.join(F.broadcast(offsets), "_bucket").select(*df.columns, *[
        (F.coalesce(F.sum(name).over(inside), F.lit(0)) + F.col(f"_offset_{name}")).alias(f"{name}_before")
        for name in sums
    ])


def numbered(df: DataFrame, order_by: Sequence[str], stage: Stage, column: str = "number") -> DataFrame:
    """Adds the place of each row, from 0, in the order of all rows. Rows with equal keys are in no fixed order."""
    placed = _in_ranges(df, order_by, stage)
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_bucket").orderBy(*order_by)
    return placed.join(F.broadcast(offsets), "_bucket").select(
        *df.columns, (F.row_number().over(inside) - 1 + F.col("_offset")).alias(column)
    )
