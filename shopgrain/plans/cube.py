"""A small table that answers the dashboard's filters: one row per state, day and review score, merged on request.

Sums and counts add up, so any choice of states and whole days is a sum over cells. A bound inside a day reads the
stored orders of that day alone, as cells of their own. The number of cells follows from states, days and scores, not from
orders. Orders must be unique by ``order_id``, as the enriched table's are.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sum_or_zero
from ..operators import keep_known_keys
from .dashboard import filter_orders

DIMENSIONS = ("customer_state", "day", "review_score_latest")
TIME = "order_purchase_timestamp"


def build_cells(orders: DataFrame) -> DataFrame:
    """Cells of enriched orders; missing states, days and scores are cells of their own."""
    return orders.withColumn("day", F.col(TIME).cast("date")).groupBy(*DIMENSIONS).agg(
        F.count("order_id").alias("n_orders"), sum_or_zero(F.col("total_order_value")).alias("revenue"),
        sum_or_zero(F.col("delivery_delay_days")).alias("delay_sum"), F.count("delivery_delay_days").alias("delay_count"),
    )


def _moment(bound: str) -> dt.datetime:
    return dt.datetime.fromisoformat(str(bound))


def choose_cells(
    cells: DataFrame, orders: DataFrame, states: Sequence[str] = (), start: str | None = None, end: str | None = None
) -> DataFrame:
    """Cells of the given states from ``start`` to ``end``, both included, as in ``filter_orders``.

    Whole days come from ``cells``. Of ``orders``, the stored table, only rows of the first and last day are read, and
    only if a bound lies inside a day; months that are partitions are pruned.
    """
    if states:
        cells = cells.where(F.col("customer_state").isin(*states))
    if not (start and end):
        return cells
    low, high = _moment(start), _moment(end)
    first = low.date() + dt.timedelta(days=low.time() > dt.time.min)
    last = high.date() - dt.timedelta(days=1)  # the last moment is included, so the last day is never whole
    whole = cells.where(F.col("day").between(F.lit(first), F.lit(last)))
    cut_days = sorted({low.date(), high.date()} if first > low.date() else {high.date()})
    ends = orders
    if {"purchase_year", "purchase_month"} <= set(orders.columns):
        months = [(F.col("purchase_year") == d.year) & (F.col("purchase_month") == d.month) for d in cut_days]
        ends = ends.where(months[0] if len(months) == 1 else months[0] | months[1])
    days = [(F.col(TIME) >= F.lit(dt.datetime.combine(d, dt.time.min)).cast("timestamp_ntz"))
            & (F.col(TIME) < F.lit(dt.datetime.combine(d + dt.timedelta(days=1), dt.time.min)).cast("timestamp_ntz")) for d in cut_days]
    ends = ends.where(days[0] if len(days) == 1 else days[0] | days[1])
    return whole.unionByName(build_cells(filter_orders(ends, states, start, end)).select(*cells.columns))


def _mean(total: str, count: str):
    return F.try_divide(F.sum(total), F.sum(count).cast("double"))


def kpis_of(cells: DataFrame) -> DataFrame:
    """The dashboard's four figures."""
    scored = F.col("review_score_latest").isNotNull()
    return cells.agg(
        sum_or_zero(F.col("revenue")).alias("total_revenue"), F.coalesce(F.sum("n_orders"), F.lit(0)).alias("n_orders"),
        _mean("delay_sum", "delay_count").alias("avg_delay"),
        F.try_divide(
            F.sum(F.col("review_score_latest") * F.col("n_orders")).cast("double"), F.sum(F.when(scored, F.col("n_orders"))).cast("double")
        ).alias("avg_review_score"),
    )


def delay_by_state_of(cells: DataFrame) -> DataFrame:
    return keep_known_keys(cells, "customer_state").groupBy("customer_state").agg(_mean("delay_sum", "delay_count").alias("avg_delay"))


def review_scores_of(cells: DataFrame) -> DataFrame:
    return keep_known_keys(cells, "review_score_latest").groupBy("review_score_latest").agg(F.sum("n_orders").alias("n_orders"))
