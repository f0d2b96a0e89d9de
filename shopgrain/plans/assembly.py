"""Order-level and item-level base tables.

Items, payments and reviews are reduced to one row per order before any join, so no join multiplies rows
and all of them share one partitioning on ``order_id``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sum_or_zero
from ..operators import keep_known_keys, lookup_join


def translate_categories(products: DataFrame, translation: DataFrame) -> DataFrame:
    """Products with an English category name; ``other`` for untranslated and missing categories.

    The match is null-safe: a translation given for the missing category applies to it.
    """
    lookup = translation.withColumnRenamed("product_category_name", "_category")
    return (
        products.join(lookup, products["product_category_name"].eqNullSafe(lookup["_category"]), "left")
        .drop("_category")
        .fillna("other", ["product_category_name_english"])
    )


def item_totals(order_items: DataFrame) -> DataFrame:
    """Items, price and freight per order."""
    return keep_known_keys(order_items, "order_id").groupBy("order_id").agg(
        F.count("order_item_id").alias("n_items"),
        sum_or_zero(F.col("price")).alias("items_price_sum"),
        sum_or_zero(F.col("freight_value")).alias("freight_value_sum"),
    )


def payment_totals(payments: DataFrame) -> DataFrame:
    """Paid amount, most frequent payment type (smallest on a tie) and most instalments per order.

    ``F.mode`` keeps a map for each order, serialized in the shuffle, and sorts the rows of a whole file split beyond 128 orders.
    Here the rows move once to their order and are numbered within their type; the highest number is the type's count.
    """
    by_type = Window.partitionBy("order_id").orderBy("payment_type")
    place = F.row_number().over(by_type) - F.rank().over(by_type) + 1
    counted = keep_known_keys(payments, "order_id").select(
        "order_id", "payment_type", "payment_value", "payment_installments", place.alias("_place")
    )
    known = F.when(F.col("payment_type").isNotNull(), F.struct(-F.col("_place"), "payment_type"))
    return counted.groupBy("order_id").agg(
        sum_or_zero(F.col("payment_value")).alias("payment_value_sum"),
        F.min(known)["payment_type"].alias("payment_type_mode"),
        F.max("payment_installments").alias("payment_installments_max"),
    )


def review_summary(latest_reviews: DataFrame) -> DataFrame:
    """Score and times per order, from reviews already reduced to one per order."""
    return keep_known_keys(latest_reviews, "order_id").groupBy("order_id").agg(
        F.max("review_score").alias("review_score_latest"),
        F.max("review_creation_date").alias("review_creation_date_max"),
        F.max("review_answer_timestamp").alias("review_answer_timestamp_max"),
    )


def attach_order_facts(orders: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Orders with item, payment and review facts; every order is kept."""
    return (
        orders.join(item_totals(tables["order_items"]), "order_id", "left")
        .join(payment_totals(tables["payments"]), "order_id", "left")
        .join(review_summary(tables["reviews"]), "order_id", "left")
    )


def attach_customers(orders: DataFrame, customers: DataFrame) -> DataFrame:
    return lookup_join(orders, customers, "customer_id", right_suffix="_customer")


def extend_items(order_items: DataFrame, products: DataFrame, sellers: DataFrame) -> DataFrame:
    """Items with the attributes of their product and seller."""
    with_products = lookup_join(order_items, products, "product_id", left_suffix="_x", right_suffix="_y")
    return lookup_join(with_products, sellers, "seller_id", left_suffix="_product", right_suffix="_seller")


def build_base_orders(tables: Mapping[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(one row per order, one row per item) from cleaned tables.

    The order facts are joined before the customers: those joins share the partitioning on ``order_id`` that
    the deduplication of orders leaves behind, and orders move to ``customer_id`` only once.
    """
    orders = attach_customers(attach_order_facts(tables["orders"], tables), tables["customers"])
    items = extend_items(tables["order_items"], tables["products"], tables["sellers"])
    return orders, items
