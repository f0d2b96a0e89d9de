"""Feature columns of the order-level table and the customer, product and seller tables behind them."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import (
    days_between, false_if_null, finite_or_null, haversine_km, month_start, safe_ratio, sum_or_zero,
    zero_if_null,
)
from ..operators import fill_domain, keep_known_keys, lookup_join
from .assembly import attach_order_facts


def add_time_features(orders: DataFrame) -> DataFrame:
    """Calendar parts of the purchase time; Monday is weekday 0."""
    ts = F.col("order_purchase_timestamp")
    return orders.withColumns({
        "purchase_year": F.year(ts),
        "purchase_month": F.month(ts),
        "purchase_day": F.dayofmonth(ts),
        "purchase_weekday": F.weekday(ts),
        "purchase_hour": F.hour(ts),
        "is_weekend": false_if_null(F.weekday(ts) >= 5),
        "order_purchase_date": month_start(ts),
    })


def add_delivery_features(orders: DataFrame) -> DataFrame:
    """Days to delivery, days promised and days past the promise; an undelivered order is not late."""
    purchase, delivered, estimated = (
        F.col("order_purchase_timestamp"),
        F.col("order_delivered_customer_date"),
        F.col("order_estimated_delivery_date"),
    )
    delay = days_between(estimated, delivered)
    return orders.withColumns({
        "delivery_time_days": days_between(purchase, delivered),
        "delivery_estimated_days": days_between(purchase, estimated),
        "delivery_delay_days": delay,
        "is_late": false_if_null(delay > 0),
    })


def add_monetary_features(orders: DataFrame) -> DataFrame:
    """Order value and mean item price; an order without items has value 0 and no mean price."""
    items, freight = zero_if_null(F.col("items_price_sum")), zero_if_null(F.col("freight_value_sum"))
    return orders.withColumns({
        "items_price_sum": items,
        "freight_value_sum": freight,
        "total_order_value": items + freight,
        "avg_item_price": safe_ratio(items, F.col("n_items")),
    })


def add_interaction_features(orders: DataFrame, missing_as_zero: bool = True) -> DataFrame:
    """Freight share of the item price, and delay times order value.

    With ``missing_as_zero`` a missing delay or value counts as 0 and both columns always exist. Without it the
    product stays missing, and a column whose inputs are absent is left out.
    """
    present = set(orders.columns)
    added = {}
    if {"freight_value_sum", "items_price_sum"} <= present:
        ratio = safe_ratio(F.col("freight_value_sum"), F.col("items_price_sum"))
        added["freight_to_price_ratio"] = zero_if_null(finite_or_null(ratio))
    elif missing_as_zero:
        added["freight_to_price_ratio"] = F.lit(0.0)
    if missing_as_zero:
        delay, value = (
            zero_if_null(F.col(name)) if name in present else F.lit(0.0)
            for name in ("delivery_delay_days", "total_order_value")
        )
        added["delay_x_total_value"] = delay * value
    elif {"delivery_delay_days", "total_order_value"} <= present:
        added["delay_x_total_value"] = F.col("delivery_delay_days") * F.col("total_order_value")
    return orders.withColumns(added) if added else orders


def add_binary_review_target(df: DataFrame) -> DataFrame:
    """1 for a score of at least 4, else 0, also for rows without a review."""
    score = "review_score_latest" if "review_score_latest" in df.columns else "review_score"
    return df.withColumn("review_binary", false_if_null(F.col(score) >= 4).cast("int"))


def customer_value(
    orders: DataFrame,
    key: str = "customer_id",
    unique_orders: bool = False,
    domain: DataFrame | None = None,
) -> DataFrame:
    """Orders, revenue, mean order value and last purchase per customer.

    ``unique_orders`` states that there is one row per order, which spares the shuffle of a distinct count.
    ``domain`` adds customers without orders, with zero orders and revenue.
    """
    n_orders = F.count("order_id") if unique_orders else F.count_distinct("order_id")
    value = keep_known_keys(orders, key).groupBy(key).agg(
        n_orders.alias("customer_n_orders"),
        sum_or_zero(F.col("total_order_value")).alias("customer_total_revenue"),
        F.avg("total_order_value").alias("customer_avg_order_value"),
        F.max("order_purchase_timestamp").alias("customer_last_purchase"),
    )
    if domain is None:
        return value
    return fill_domain(value, domain, key, {"customer_n_orders": 0, "customer_total_revenue": 0.0})


def add_customer_value(
    orders: DataFrame, key: str = "customer_id", unique_orders: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(orders with the customer columns attached, the customer table)."""
    value = customer_value(orders, key, unique_orders)
    return lookup_join(orders, value, key), value


def review_stats(scored: DataFrame, key: str, score: str, prefix: str) -> DataFrame:
    """Mean score and number of scores per key."""
    return keep_known_keys(scored, key).groupBy(key).agg(
        F.avg(score).alias(f"{prefix}_review_score_mean"), F.count(score).alias(f"{prefix}_review_count")
    )


def product_and_seller_review_stats(
    order_items: DataFrame, reviews: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Review statistics of products and of sellers; the score of an order counts once per item."""
    scored = lookup_join(
        order_items.select("order_id", "product_id", "seller_id"), reviews.select("order_id", "review_score"), "order_id"
    )
    return (
        review_stats(scored, "product_id", "review_score", "product"),
        review_stats(scored, "seller_id", "review_score", "seller"),
    )


def add_review_aggregates(
    orders: DataFrame, order_items: DataFrame, reviews: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(orders with customer review statistics, product statistics, seller statistics)."""
    by_product, by_seller = product_and_seller_review_stats(order_items, reviews)
    by_customer = review_stats(orders, "customer_id", "review_score_latest", "customer")
    return lookup_join(orders, by_customer, "customer_id"), by_product, by_seller


def zip_centroids(geolocation: DataFrame) -> DataFrame:
    """Mean coordinates per zip prefix."""
    return keep_known_keys(geolocation, "geolocation_zip_code_prefix").groupBy("geolocation_zip_code_prefix").agg(
        F.avg("geolocation_lat").alias("geo_lat"), F.avg("geolocation_lng").alias("geo_lng")
    )


def place(entities: DataFrame, who: str, centroids: DataFrame) -> DataFrame:
    """``<who>_id``, ``<who>_lat``, ``<who>_lng`` for customers or sellers; NULL for an unknown zip."""
    keys = entities.select(f"{who}_id", F.col(f"{who}_zip_code_prefix").alias("_zip"))
    points = centroids.select(
        F.col("geolocation_zip_code_prefix").alias("_zip"),
        F.col("geo_lat").alias(f"{who}_lat"),
        F.col("geo_lng").alias(f"{who}_lng"),
    )
    return lookup_join(keys, points, "_zip").drop("_zip")


def order_distance(
    orders: DataFrame, customers: DataFrame, sellers: DataFrame, geolocation: DataFrame, order_items: DataFrame
) -> DataFrame:
    """Mean customer-to-seller distance per order.

    The customer's position is looked up once per order, not once per item; items carry two keys and two
    coordinates through one shuffle, and the mean is begun before the next one, to one row per order.
    """
    centroids = zip_centroids(geolocation)
    order_points = lookup_join(
        orders.select("order_id", "customer_id"), place(customers, "customer", centroids), "customer_id"
    )
    item_points = lookup_join(
        keep_known_keys(order_items.select("order_id", "seller_id"), "order_id"),
        place(sellers, "seller", centroids), "seller_id",
    )
    distance = haversine_km(
        F.col("customer_lat"), F.col("customer_lng"), F.col("seller_lat"), F.col("seller_lng")
    )
    return (
        lookup_join(item_points, order_points, "order_id")
        .groupBy("order_id")
        .agg(F.avg(distance).alias("distance_km_mean"))
    )


def add_distance(
    orders: DataFrame, customers: DataFrame, sellers: DataFrame, geolocation: DataFrame, order_items: DataFrame
) -> DataFrame:
    return orders.join(order_distance(orders, customers, sellers, geolocation, order_items), "order_id", "left")


def customer_value_as_of_order(orders: DataFrame) -> DataFrame:
    """What was known of the customer when the order was placed: orders, revenue, mean order value of strictly earlier orders.

    Totals over all orders tell a model of the future; these do not. Per customer and day the orders are summed once; running
    sums over a customer's days, at most one row a day, are carried into each day, and only orders of one day are
    compared with each other. So a customer with a third of all orders is split into as many parts as days.
    """
    at, day = F.col("order_purchase_timestamp"), F.col("order_purchase_timestamp").cast("date")
    known = keep_known_keys(orders, "customer_id").where(at.isNotNull()).select(
        "order_id", "customer_id", "order_purchase_timestamp", "total_order_value", day.alias("day")
    )
    sums = {
        "customer_prior_orders": F.count("order_id"), "customer_prior_revenue": F.sum("total_order_value"),
        "_values": F.count("total_order_value"),
    }
    days = known.groupBy("customer_id", "day").agg(*[value.alias(name) for name, value in sums.items()])
    before = Window.partitionBy("customer_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    carried = days.select("customer_id", "day", *[F.coalesce(F.sum(name).over(before), F.lit(0)).alias(f"_{name}") for name in sums])
    within = Window.partitionBy("customer_id", "day").orderBy(F.unix_micros(at.cast("timestamp"))).rangeBetween(Window.unboundedPreceding, -1)
    earlier = known.withColumns({name: value.over(within) for name, value in sums.items()})
    joined = lookup_join(earlier, carried, ["customer_id", "day"])
    total = {name: F.coalesce(name, F.lit(0)) + F.col(f"_{name}") for name in sums}
    return joined.select(
        "order_id", "customer_id", "order_purchase_timestamp", *[total[n].alias(n) for n in list(sums)[:2]],
        F.try_divide(total["customer_prior_revenue"].cast("double"), total["_values"].cast("double")).alias("customer_prior_avg_order_value"),
    )


@dataclass(frozen=True)
class FeatureSet:
    """Target and inputs of one prediction task."""

    target: str
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]

    @property
    def inputs(self) -> tuple[str, ...]:
        return self.numeric + self.categorical


# The inputs of the prediction tasks.
FEATURE_SETS = {
    "delay": FeatureSet(
        target="delivery_delay_days",
        numeric=(
            "items_price_sum", "freight_value_sum", "payment_value_sum", "n_items", "total_order_value",
            "distance_km_mean", "delivery_estimated_days", "purchase_month", "purchase_hour",
            "freight_to_price_ratio",
        ),
        categorical=("payment_type_mode", "customer_state", "is_weekend"),
    ),
    "review": FeatureSet(
        target="review_score_latest",
        numeric=(
            "total_order_value", "n_items", "delivery_delay_days", "distance_km_mean", "customer_total_revenue",
            "customer_n_orders", "freight_to_price_ratio", "delay_x_total_value",
        ),
        categorical=("payment_type_mode", "customer_state"),
    ),
}


def build_order_facts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Orders with every feature that does not depend on their customer's other orders, from cleaned tables."""
    facts = attach_order_facts(tables["orders"], tables).join(
        order_distance(
            tables["orders"], tables["customers"], tables["sellers"], tables["geolocation"], tables["order_items"]
        ),
        "order_id",
        "left",
    )
    return (
        facts.transform(add_time_features)
        .transform(add_delivery_features)
        .transform(add_monetary_features)
        .transform(add_interaction_features)
    )


def build_enriched_orders(
    tables: Mapping[str, DataFrame], stage: Callable[[DataFrame], DataFrame] = lambda df: df
) -> DataFrame:
    """The order-level table with every feature, from cleaned tables.

    All steps keyed by ``order_id`` come first, on the partitioning that deduplicating the orders created;
    then the wide rows move once to ``customer_id``, where the customer attributes, customer value and
    customer review statistics arrive as one table. ``stage`` is applied to the order-level facts, which both
    the customer aggregation and the final join read: pass ``materialize`` to compute them once on large data.
    """
    facts = stage(build_order_facts(tables))
    per_customer = keep_known_keys(facts, "customer_id").groupBy("customer_id").agg(
        F.count("order_id").alias("customer_n_orders"),
        sum_or_zero(F.col("total_order_value")).alias("customer_total_revenue"),
        F.avg("total_order_value").alias("customer_avg_order_value"),
        F.max("order_purchase_timestamp").alias("customer_last_purchase"),
        F.avg("review_score_latest").alias("customer_review_score_mean"),
        F.count("review_score_latest").alias("customer_review_count"),
    )
    attributes = per_customer.join(tables["customers"], "customer_id", "left")
    return lookup_join(facts, attributes, "customer_id", right_suffix="_customer")
