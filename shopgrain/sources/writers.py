"""Sinks of the workflow."""

from __future__ import annotations

from pyspark.sql import DataFrame

MONTH_PARTITIONS = ("purchase_year", "purchase_month")


def write_enriched_orders(
    orders: DataFrame, path: str, fmt: str = "parquet", partition_by_month: bool = False
) -> None:
    """Write the order-level table, columnar by default.

    With month partitions the rows are rebalanced first: each month lands in few files of sensible size,
    and adaptive execution splits a month that holds far more rows than the others.
    """
    writer = orders
    if partition_by_month:
        writer = orders.hint("rebalance", *MONTH_PARTITIONS)
    writer = writer.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    if partition_by_month:
        writer = writer.partitionBy(*MONTH_PARTITIONS)
    writer.save(path)


def write_small_csv(rows: DataFrame, path: str) -> None:
    """One header CSV file. For results of a fixed size, such as a top ten."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_top_tables(categories: DataFrame, sellers: DataFrame, base: str, k: int = 10) -> dict[str, str]:
    """The best ``k`` categories and sellers of two already ranked tables."""
    paths = {"categories": f"{base}/top_categories", "sellers": f"{base}/top_sellers"}
    for name, ranked, key in (
        ("categories", categories, "product_category_name_english"),
        ("sellers", sellers, "seller_id"),
    ):
        best = ranked.orderBy(ranked["revenue"].desc(), ranked[key]).limit(k)
        write_small_csv(best, paths[name])
    return paths
