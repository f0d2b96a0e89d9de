"""The end-to-end run: input tables in, exported tables out."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from ..session import materialize
from ..sources import write_enriched_orders, write_top_tables
from .assembly import translate_categories
from .cleaning import clean_tables
from .features import add_binary_review_target, build_enriched_orders
from .reports import top_categories, top_sellers


def prepare_tables(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Cleaned tables with translated product categories."""
    cleaned = clean_tables(tables)
    cleaned["products"] = translate_categories(cleaned["products"], cleaned["category_translation"])
    return cleaned


def run_workflow(
    spark: SparkSession, tables: Mapping[str, DataFrame], out: str, fmt: str = "parquet",
    partition_by_month: bool = False,
) -> dict[str, str]:
    """Clean, enrich and export; returns the paths of the enriched orders and the two rankings."""
    cleaned = prepare_tables(tables)
    enriched = build_enriched_orders(cleaned, stage=materialize).transform(add_binary_review_target)
    paths = {"enriched_orders": f"{out}/enriched_orders"}
    write_enriched_orders(enriched, paths["enriched_orders"], fmt, partition_by_month)
    paths.update(write_top_tables(
        top_categories(cleaned["order_items"], cleaned["products"]), top_sellers(cleaned["order_items"]), out
    ))
    return paths
