"""One test per rule on missing values, each on rows written by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shopgrain.functions import (
    decimals, finite_or_null, haversine_km, nan_to_null, number_or_null, padded_label, percent, safe_ratio,
    thousands, timestamp_or_null,
)
from shopgrain.operators import (
    at_or_above_quantile, correlation_matrix, exact_quantiles, fill_domain, keep_first, top_k,
)
from shopgrain.plans import assembly, cleaning, features

NAN = float("nan")
DAY = dt.datetime(2020, 2, 29, 18, 30)


def one(spark, expression):
    return spark.range(1).select(expression.alias("v")).first()["v"]


def test_comparison_with_missing_is_false(spark, rows):
    orders = spark.createDataFrame(
        [(1, DAY, DAY, None), (2, DAY, DAY, DAY), (3, DAY, DAY, DAY + dt.timedelta(hours=6))],
        "order_id int, order_purchase_timestamp timestamp_ntz, order_estimated_delivery_date timestamp_ntz, "
        "order_delivered_customer_date timestamp_ntz",
    )
    late = features.add_delivery_features(orders).select("order_id", "is_late", "delivery_delay_days")
    assert rows(late) == [(1, False, None), (2, False, 0.0), (3, True, 0.25)]
    scores = spark.createDataFrame([(None,), (3,), (4,)], "review_score_latest int")
    assert rows(features.add_binary_review_target(scores)) == [(3, 0), (4, 1), (None, 0)]


def test_binary_target_falls_back_to_review_score(spark, rows):
    assert rows(features.add_binary_review_target(spark.createDataFrame([(5,)], "review_score int"))) == [(5, 1)]


def test_nan_is_missing(spark):
    assert one(spark, nan_to_null(F.lit(NAN))) is None
    assert one(spark, finite_or_null(F.lit(float("-inf")))) is None
    assert one(spark, finite_or_null(F.lit(2.0))) == 2.0
    items = spark.createDataFrame([(1, 1, 1, 1, NAN, 2.0)],
                                  "order_id int, product_id int, seller_id int, order_item_id int, price double, freight_value double")
    cleaned = cleaning.clean_tables({"order_items": items})["order_items"]
    totals = assembly.item_totals(cleaned).first()
    assert (totals["items_price_sum"], totals["freight_value_sum"], totals["n_items"]) == (0.0, 2.0, 1)


def test_sum_of_nothing_is_zero(spark, rows):
    payments = spark.createDataFrame([(1, None, None, None)],
                                     "order_id int, payment_type string, payment_value double, payment_installments int")
    assert rows(assembly.payment_totals(payments)) == [(1, 0.0, None, None)]


def test_missing_key_forms_no_group(spark, rows):
    places = spark.createDataFrame([(None, 1.0, 1.0), (5, 1.0, 2.0), (5, 3.0, 4.0)],
                                   "geolocation_zip_code_prefix int, geolocation_lat double, geolocation_lng double")
    assert rows(features.zip_centroids(places)) == [(5, 2.0, 3.0)]


def test_counts_skip_missing(spark):
    items = spark.createDataFrame([(1, None, 1.0, 1.0), (1, 7, 1.0, 1.0)],
                                  "order_id int, order_item_id int, price double, freight_value double")
    assert assembly.item_totals(items).first()["n_items"] == 1


def test_missing_category_meets_missing_translation(spark, rows):
    products = spark.createDataFrame([(1, "a"), (2, None), (3, "z")], "product_id int, product_category_name string")
    lookup = "product_category_name string, product_category_name_english string"
    with_null = spark.createDataFrame([("a", "apple"), (None, "nothing")], lookup)
    without = spark.createDataFrame([("a", "apple")], lookup)
    assert rows(assembly.translate_categories(products, with_null)) == [
        (1, "a", "apple"), (2, None, "nothing"), (3, "z", "other")]
    assert rows(assembly.translate_categories(products, without)) == [
        (1, "a", "apple"), (2, None, "other"), (3, "z", "other")]


def test_review_without_answer_time_is_latest(spark, rows):
    reviews = spark.createDataFrame(
        [(1, 5, DAY), (1, 2, None), (2, 3, DAY), (2, 4, DAY + dt.timedelta(days=1))],
        "order_id int, review_score int, review_answer_timestamp timestamp_ntz",
    )
    kept = cleaning.latest_review_per_order(reviews)
    assert rows(kept.select("order_id", "review_score")) == [(1, 2), (2, 4)]
    without_time = reviews.drop("review_answer_timestamp")
    assert cleaning.latest_review_per_order(without_time).count() == 4


def test_keep_first_treats_missing_keys_as_equal(spark, rows):
    df = spark.createDataFrame([(None, 2), (None, 1), (1, 9), (1, 8)], "k int, v int")
    assert rows(keep_first(df, ["k"])) == [(1, 8), (None, 1)]
    assert rows(keep_first(df, ["k"], [F.col("v").desc()])) == [(1, 9), (None, 2)]


def test_dedup_precedes_the_key_check(spark):
    """The kept duplicate lacks its customer, so the order disappears although another copy is complete."""
    orders = spark.createDataFrame([(1, None, "x", DAY), (1, 5, "y", DAY)],
                                   "order_id int, customer_id int, order_status string, order_purchase_timestamp timestamp_ntz")
    assert cleaning.clean_tables({"orders": orders})["orders"].count() == 0


def test_ratio_by_zero_is_missing(spark):
    assert one(spark, safe_ratio(F.lit(1.0), F.lit(0.0))) is None
    orders = spark.createDataFrame([(None, None, None)], "items_price_sum double, freight_value_sum double, n_items bigint")
    row = features.add_monetary_features(orders).first()
    assert (row["total_order_value"], row["avg_item_price"]) == (0.0, None)


@pytest.mark.parametrize("text, number", [
    ("12.5", 12.5), (" 7 ", 7.0), ("n/a", None), ("1.5d", None), ("2f", None), ("NaN", None), ("", None), ("-3e2", -300.0),
])
def test_number_coercion_never_fails(spark, text, number):
    assert one(spark, number_or_null(F.lit(text))) == number


def test_time_coercion_never_fails(spark):
    assert one(spark, timestamp_or_null(F.lit("bad"))) is None
    assert one(spark, timestamp_or_null(F.lit("2020-02-29 18:30:00"))) == DAY


def test_mode_smallest_on_tie_and_ignores_missing(spark, rows):
    payments = spark.createDataFrame(
        [(1, "b", 1.0, 1), (1, "a", 1.0, 3), (1, None, 1.0, 2), (1, None, 1.0, 2), (2, "z", 1.0, 1), (2, "z", 1.0, 1),
         (2, "a", 1.0, 1)],
        "order_id int, payment_type string, payment_value double, payment_installments int",
    )
    assert rows(assembly.payment_totals(payments)) == [(1, 4.0, "a", 3), (2, 3.0, "z", 1)]


def test_summary_keeps_score_of_review_without_time(spark, rows):
    reviews = spark.createDataFrame([(1, 2, DAY, None)],
                                    "order_id int, review_score int, review_creation_date timestamp_ntz, review_answer_timestamp timestamp_ntz")
    assert rows(assembly.review_summary(reviews)) == [(1, 2, DAY, None)]


def test_unobserved_groups_on_request(spark, rows):
    orders = spark.createDataFrame([(1, 10, 5.0, DAY)],
                                   "order_id int, customer_id int, total_order_value double, order_purchase_timestamp timestamp_ntz")
    domain = spark.createDataFrame([(10,), (11,), (11,)], "customer_id int")
    assert rows(features.customer_value(orders)) == [(10, 1, 5.0, 5.0, DAY)]
    assert rows(features.customer_value(orders, domain=domain)) == [(10, 1, 5.0, 5.0, DAY), (11, 0, 0.0, None, None)]
    counted = spark.createDataFrame([("a", 2)], "state string, n int")
    states = spark.createDataFrame([("a",), ("b",)], "state string")
    assert rows(fill_domain(counted, states, "state", {"n": 0})) == [("a", 2), ("b", 0)]


def test_calendar(spark):
    orders = spark.createDataFrame([(DAY,), (None,)], "order_purchase_timestamp timestamp_ntz")
    known, unknown = features.add_time_features(orders).collect()
    assert tuple(known)[1:] == (2020, 2, 29, 5, 18, True, dt.datetime(2020, 2, 1))
    assert unknown["is_weekend"] is False and unknown["purchase_year"] is None
    assert features.add_time_features(orders).schema["order_purchase_date"].dataType.simpleString() == "timestamp_ntz"


def test_quantile_is_interpolated(spark, rows):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 10)] + [(None,), (NAN,)], "v double")
    assert exact_quantiles(df, "v", {"q": 0.95}).first()["q"] == pytest.approx(3 + 0.85 * 7)
    assert rows(at_or_above_quantile(df.dropna(), "v", 0.95)) == [(10.0,)]


def test_correlation_is_pairwise_complete(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0), (2.0, 4.0, 1.0), (3.0, None, 1.0), (NAN, 9.0, 1.0)], "a double, b double, c double")
    got = {(r["col_a"], r["col_b"]): r["corr"] for r in correlation_matrix(df, ["a", "b", "c", "absent"]).collect()}
    assert len(got) == 9
    assert got["a", "b"] == got["b", "a"] == pytest.approx(1.0)
    assert got["a", "a"] == pytest.approx(1.0)
    assert got["c", "c"] is None and got["a", "c"] is None


def test_top_k_breaks_ties_by_key_and_puts_missing_last(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", None), ("d", 2.0)], "k string, v double")
    assert [r["k"] for r in top_k(df, "v", "k", 4).collect()] == ["d", "a", "b", "c"]


def test_distance_propagates_missing(spark):
    def km(*point):
        return one(spark, haversine_km(*[F.lit(c).cast("double") for c in point]))

    assert km(None, 0, 0, 0) is None
    assert km(0, 0, 0, 0) == 0.0
    assert km(0, 0, 0, 180) == pytest.approx(3.141592653589793 * 6371.0)
    assert km(-90, 0, 90, 0) == pytest.approx(3.141592653589793 * 6371.0)
    assert km(-23.55, -46.63, -22.91, -43.17) == pytest.approx(360.7, abs=1.0)


def test_interaction_variants(spark, rows):
    orders = spark.createDataFrame([(2.0, 0.0, None, 5.0), (1.0, 4.0, 2.0, None)],
                                   "freight_value_sum double, items_price_sum double, delivery_delay_days double, total_order_value double")
    names = ["freight_to_price_ratio", "delay_x_total_value"]
    assert rows(features.add_interaction_features(orders).select(*names)) == [(0.0, 0.0), (0.25, 0.0)]
    assert rows(features.add_interaction_features(orders, missing_as_zero=False).select(*names)) == [(0.0, None), (0.25, None)]
    bare = spark.createDataFrame([(1,)], "order_id int")
    assert rows(features.add_interaction_features(bare)) == [(1, 0.0, 0.0)]
    assert features.add_interaction_features(bare, missing_as_zero=False).columns == ["order_id"]


def test_formats(spark):
    assert one(spark, thousands(F.lit(1234567.5), 2)) == "1,234,567.50"
    assert one(spark, decimals(F.lit(1234.567), 2)) == "1234.57"
    assert one(spark, percent(F.lit(0.1234), 1)) == "12.3%"
    assert one(spark, padded_label("C", F.lit(7))) == "C07"
    assert one(spark, padded_label("C", F.lit(123))) == "C123"
