"""Queries of the interactive dashboard, as functions of the enriched orders and the chosen filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sum_or_zero
from ..operators import count_by
from ..sources import load_enriched_orders, load_optional
from .reports import mean_by_state, top_customers_of_orders


def filter_orders(
    orders: DataFrame, states: Sequence[str] = (), start: str | None = None, end: str | None = None
) -> DataFrame:
    """Orders of the given states (all if none given) bought from ``start`` to ``end``, both included.

    Dates apply only if both are given; a bare date means its midnight. The bounds are zone-free constants, so
    they reach the Parquet scan.
    """
    if states:
        orders = orders.where(F.col("customer_state").isin(*states))
    if start and end and "order_purchase_timestamp" in orders.columns:
        low, high = (F.lit(str(bound)).cast("timestamp_ntz") for bound in (start, end))
        orders = orders.where(F.col("order_purchase_timestamp").between(low, high))
    return orders


def state_options(orders: DataFrame) -> DataFrame:
    """Selectable states in order."""
    return orders.select("customer_state").dropna().distinct().orderBy("customer_state")


def date_bounds(orders: DataFrame) -> DataFrame:
    """First and last purchase time."""
    ts = "order_purchase_timestamp"
    return orders.agg(F.min(ts).alias("date_min"), F.max(ts).alias("date_max"))


def dashboard_kpis(orders: DataFrame, unique_orders: bool = False) -> DataFrame:
    """One row of KPIs; a KPI whose column is absent is NULL (0 for sums and counts)."""
    present = set(orders.columns)
    n_orders = F.count("order_id") if unique_orders else F.count_distinct("order_id")

    def mean(name):
        return F.avg(name) if name in present else F.max(F.lit(None).cast("double"))

    return orders.agg(
        (sum_or_zero(F.col("total_order_value")) if "total_order_value" in present else F.max(F.lit(0.0)))
        .alias("total_revenue"),
        (n_orders if "order_id" in present else F.count(F.lit(None))).alias("n_orders"),
        mean("delivery_delay_days").alias("avg_delay"),
        mean("review_score_latest").alias("avg_review_score"),
    )


def delay_by_state(orders: DataFrame) -> DataFrame:
    return mean_by_state(orders, F.col("delivery_delay_days"), "avg_delay")


def review_score_counts(orders: DataFrame) -> DataFrame:
    return count_by(orders, "review_score_latest", "n_orders")


def delay_review_pairs(orders: DataFrame) -> DataFrame:
    """Points of the delay-against-score chart."""
    return orders.select("order_id", "delivery_delay_days", "review_score_latest")


@dataclass(frozen=True)
class Dashboard:
    """The datasets one refresh shows. Category and seller rankings do not follow the filters."""

    kpis: DataFrame
    top_categories: DataFrame
    top_sellers: DataFrame
    delay_by_state: DataFrame | None
    top_customers: DataFrame
    review_scores: DataFrame | None
    delay_vs_review: DataFrame | None


def refresh(
    orders: DataFrame,
    top_categories: DataFrame,
    top_sellers: DataFrame,
    states: Sequence[str] = (),
    start: str | None = None,
    end: str | None = None,
    unique_orders: bool = False,
) -> Dashboard:
    """All dashboard datasets for one choice of filters; a chart whose columns are absent is None."""
    chosen = filter_orders(orders, states, start, end)
    present = set(chosen.columns)
    return Dashboard(
        kpis=dashboard_kpis(chosen, unique_orders),
        top_categories=top_categories,
        top_sellers=top_sellers,
        delay_by_state=delay_by_state(chosen) if {"customer_state", "delivery_delay_days"} <= present else None,
        top_customers=top_customers_of_orders(chosen),
        review_scores=review_score_counts(chosen) if "review_score_latest" in present else None,
        delay_vs_review=(
            delay_review_pairs(chosen) if {"delivery_delay_days", "review_score_latest"} <= present else None
        ),
    )


def refresh_export(
    spark: SparkSession, paths: Mapping[str, str], states: Sequence[str] = (), start: str | None = None, end: str | None = None
) -> Dashboard:
    """One refresh from what a workflow run has written: the enriched orders, and the two rankings if they are there."""
    return refresh(
        load_enriched_orders(spark, paths["enriched_orders"]),
        load_optional(spark, paths.get("categories"), "product_category_name_english string, revenue double, n_items bigint"),
        load_optional(spark, paths.get("sellers"), "seller_id string, revenue double, n_items bigint"),
        states, start, end, unique_orders=True,
    )
