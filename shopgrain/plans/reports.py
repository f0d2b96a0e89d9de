"""Rankings, trends and KPIs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import decimals, percent, sum_or_zero, thousands
from ..operators import keep_known_keys, rank_labels, top_k


def monthly_orders_and_revenue(orders: DataFrame) -> DataFrame:
    """Orders and revenue per purchase month."""
    return (
        keep_known_keys(orders, "order_purchase_date")
        .groupBy("order_purchase_date")
        .agg(F.count("order_id").alias("n_orders"), sum_or_zero(F.col("total_order_value")).alias("revenue"))
        .orderBy("order_purchase_date")
    )


def _sales_by(items: DataFrame, key: str) -> DataFrame:
    return keep_known_keys(items, key).groupBy(key).agg(
        sum_or_zero(F.col("price")).alias("revenue"), F.count("order_item_id").alias("n_items")
    )


def category_sales(order_items: DataFrame, products: DataFrame) -> DataFrame:
    """Revenue and items per English category; items of unknown products belong to none.

    Items are summed per product before they meet the product table: what is shuffled and joined is one row
    per product, however many items a product or a category has.
    """
    per_product = _sales_by(order_items, "product_id")
    labelled = per_product.join(products.select("product_id", "product_category_name_english"), "product_id")
    return (
        keep_known_keys(labelled, "product_category_name_english")
        .groupBy("product_category_name_english")
        .agg(F.sum("revenue").alias("revenue"), F.sum("n_items").alias("n_items"))
    )


def top_categories(order_items: DataFrame, products: DataFrame, k: int = 15) -> DataFrame:
    return top_k(category_sales(order_items, products), "revenue", "product_category_name_english", k)


def top_sellers(order_items: DataFrame, k: int = 15) -> DataFrame:
    """Best sellers by revenue. No seller attribute is needed, so the seller table is not read."""
    return top_k(_sales_by(order_items, "seller_id"), "revenue", "seller_id", k)


def sales_by_every_key(order_items: DataFrame, products: DataFrame, orders: DataFrame) -> DataFrame:
    """Revenue and items by category, product, seller, purchase month and customer state, as (grouping, key, ...).

    One scan of the items: they meet the products and the orders once, and all groupings are combined in the same
    aggregation before the shuffle. ``orders`` has the customers' states. Missing keys form no group.
    """
    keys = {
        "category": F.col("product_category_name_english"), "product": F.col("product_id").cast("string"),
        "seller": F.col("seller_id").cast("string"), "month": F.date_format("order_purchase_timestamp", "yyyy-MM"),
        "state": F.col("customer_state"),
    }
    rows = (
        order_items.select("order_id", "order_item_id", "product_id", "seller_id", "price")
        .join(products.select("product_id", "product_category_name_english"), "product_id", "left")
        .join(orders.select("order_id", "order_purchase_timestamp", "customer_state"), "order_id", "left")
        .select(*[key.alias(name) for name, key in keys.items()], "price", "order_item_id")
    )
    # The sum over known keys of one grouping: with all other keys blank, the grouping's number says which it is.
    grouped = rows.groupingSets([[F.col(name)] for name in keys], *keys).agg(
        F.grouping_id().alias("id"), sum_or_zero(F.col("price")).alias("revenue"), F.count("order_item_id").alias("n_items")
    )
    last = len(keys) - 1
    names = {(1 << len(keys)) - 1 - (1 << (last - i)): name for i, name in enumerate(keys)}
    grouping = F.coalesce(*[F.when(F.col("id") == number, F.lit(name)) for number, name in names.items()])
    return grouped.select(grouping.alias("grouping"), F.coalesce(*keys).alias("key"), "revenue", "n_items").where(F.col("key").isNotNull())


def top_customers(customer_value: DataFrame, k: int = 5) -> DataFrame:
    """Best customers by total revenue, from the customer table."""
    best = top_k(customer_value, "customer_total_revenue", "customer_id", k)
    return best.select("customer_id", "customer_total_revenue", "customer_n_orders")


def top_customers_of_orders(orders: DataFrame, k: int = 15) -> DataFrame:
    """Best customers among those with an order in ``orders``, labelled ``C01`` and so on.

    Revenue and order count are customer-level facts that every order row repeats, so they are also those of
    orders not in ``orders``.
    """
    needed = {"customer_id", "customer_total_revenue", "customer_n_orders"}
    if not needed <= set(orders.columns):
        return orders.sparkSession.createDataFrame(
            [], f"customer_id {dict(orders.dtypes).get('customer_id', 'string')}, customer_total_revenue double, "
            "customer_n_orders bigint, customer_label string"
        )
    customers = orders.groupBy("customer_id").agg(
        F.max("customer_total_revenue").alias("customer_total_revenue"),
        F.max("customer_n_orders").alias("customer_n_orders"),
    )
    best = top_k(customers, "customer_total_revenue", "customer_id", k)
    return rank_labels(best, "customer_total_revenue", "customer_id", "customer_label")


def business_kpis(orders: DataFrame, unique_orders: bool = False) -> DataFrame:
    """One row: revenue, orders, mean order value, mean score, share of late orders among all orders."""
    n_orders = F.count("order_id") if unique_orders else F.count_distinct("order_id")
    return orders.agg(
        sum_or_zero(F.col("total_order_value")).alias("total_revenue"),
        n_orders.alias("n_orders"),
        F.avg("total_order_value").alias("avg_order_value"),
        F.avg("review_score_latest").alias("avg_review_score"),
        F.avg(F.col("is_late").cast("int")).alias("late_delivery_rate"),
    )


def _labelled(kpis: DataFrame, entries: list[tuple[str, Column]]) -> DataFrame:
    """(KPI, Value) rows from one row of numbers; a missing number is shown as a dash."""
    rows = [
        F.struct(F.lit(label).alias("KPI"), F.coalesce(value, F.lit("-")).alias("Value")) for label, value in entries
    ]
    return kpis.select(F.inline(F.array(*rows)))


def kpi_table(kpis: DataFrame) -> DataFrame:
    """Formatted business KPIs."""
    # Labels and formats of the KPI table.
    return _labelled(kpis, [
        ("Total revenue (BRL)", thousands(F.col("total_revenue"))),
        ("Number of orders", thousands(F.col("n_orders"))),
        ("Average order value (BRL)", thousands(F.col("avg_order_value"), 2)),
        ("Average review score (1–5)", decimals(F.col("avg_review_score"), 2)),
        ("Late delivery rate", percent(F.col("late_delivery_rate"), 1)),
    ])


def dashboard_kpi_table(kpis: DataFrame) -> DataFrame:
    """Formatted dashboard KPIs."""
    # Labels and formats of the dashboard.
    return _labelled(kpis, [
        ("Total revenue (BRL)", thousands(F.col("total_revenue"))),
        ("Number of orders", thousands(F.col("n_orders"))),
        ("Average delay (days)", decimals(F.col("avg_delay"), 2)),
        ("Average review score", decimals(F.col("avg_review_score"), 2)),
    ])


def mean_by_state(rows: DataFrame, value: Column, name: str, k: int | None = None) -> DataFrame:
    """Mean of ``value`` per customer state, largest first, all states or the first ``k``."""
    means = keep_known_keys(rows, "customer_state").groupBy("customer_state").agg(F.avg(value).alias(name))
    ordered = means.orderBy(F.col(name).desc_nulls_last(), "customer_state")
    return ordered.limit(k) if k else ordered


def error_by_state(predictions: DataFrame, actual: str, predicted: str, k: int = 10) -> DataFrame:
    """States where predictions are furthest off, by mean absolute error."""
    return mean_by_state(predictions, F.abs(F.col(actual) - F.col(predicted)), "mean_abs_error", k)
