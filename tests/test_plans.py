"""Physical plans: what reaches the scan, what is shuffled, and what never appears."""

import re
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from checks import queries as registered
from checks.queries import QUERIES
from shopgrain.operators import keep_first, lookup_join
from shopgrain.plans import assembly, cleaning, dashboard, features, reports

@contextmanager
def skew_settings(spark):
    """No broadcasts, and thresholds at which the few rows of a test count as skewed."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1KB",
        "spark.sql.shuffle.partitions": "20",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, previous in before.items():
            spark.conf.unset(key) if previous is None else spark.conf.set(key, previous)


LAZY = [
    "monthly_orders_revenue", "base_order_table", "extended_items", "business_kpis", "order_distances",
    "product_review_stats", "seller_review_stats", "top_categories", "top_sellers", "dashboard_kpis",
    "dashboard_delay_by_state", "base_missingness", "correlation_of_order_facts", "delay_histogram",
    "score_classification_report", "quality_threshold_curve", "holdout_split", "customer_value_table",
]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_python_and_no_cross_join(name, spark, smallest_dir):
    plan = plan_of(QUERIES[name](spark, smallest_dir))
    for banned in ("PythonUDF", "ArrowEvalPython", "BatchEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert banned not in plan, banned


@pytest.mark.parametrize("name", LAZY)
def test_no_window_over_a_whole_table(name, spark, smallest_dir):
    plan = plan_of(QUERIES[name](spark, smallest_dir))
    for window in re.findall(r"Window \[.*", plan):
        assert not re.search(r"\], *$", window) and "partitionBy" not in window
        assert re.search(r"\], \[[^\]]+\](, \[[^\]]*\])?$", window), window


def test_dedup_limits_each_key_before_the_shuffle(spark):
    plan = plan_of(keep_first(spark.range(10).select((F.col("id") % 2).alias("k"), "id"), ["k"]))
    partial, exchange = plan.index("row_number(), 1, Partial"), plan.index("Exchange hashpartitioning")
    assert plan.index("row_number(), 1, Final") < exchange < partial


def test_dashboard_filter_reaches_the_scan(spark, smallest_dir, tmp_path):
    path = str(tmp_path / "enriched")
    registered.enriched(spark, smallest_dir).select(
        "order_id", "customer_state", "order_purchase_timestamp", "total_order_value", "delivery_delay_days",
        "review_score_latest",
    ).write.parquet(path)
    orders = spark.read.parquet(path)
    chosen = dashboard.filter_orders(orders, ["NATION_1"], "1996-01-01", "1997-01-01 12:00:00")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = plan_of(dashboard.delay_by_state(chosen))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema: struct<(.*?)>", plan)
    assert "GreaterThanOrEqual(order_purchase_timestamp" in pushed[1] and "customer_state" in pushed[1]
    assert set(re.findall(r"(\w+):", pushed[2])) == {"customer_state", "order_purchase_timestamp", "delivery_delay_days"}


def test_seller_ranking_reads_items_only(spark, smallest_dir):
    plan = plan_of(QUERIES["top_sellers"](spark, smallest_dir))
    assert plan.count("FileScan") == 1 and "TakeOrderedAndProject" in plan


def test_categories_are_summed_per_product_before_the_join(spark, smallest_dir):
    plan = plan_of(QUERIES["top_categories"](spark, smallest_dir))
    join = plan.index("Join")
    assert "partial_sum(price" in plan[join:] and "partial_sum(price" not in plan[:join]


def test_small_lookups_are_broadcast_on_their_measured_size(spark, smallest_dir):
    tables = registered.prepared(spark, smallest_dir)
    assert "BroadcastHashJoin" in plan_of(tables["products"])
    positions = features.place(tables["sellers"], "seller", features.zip_centroids(tables["geolocation"]))
    assert "BroadcastHashJoin" in plan_of(positions)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        large = registered.prepared(spark, smallest_dir)
        assert "Broadcast" not in plan_of(large["products"])
        assert "Broadcast" not in plan_of(registered.enriched(spark, smallest_dir))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_large_plan_gives_the_same_result(spark, smallest_dir, rows):
    """Without any broadcast, as on large tables, every join shuffles; results stay."""
    def shown():
        df = registered.enriched(spark, smallest_dir)
        return rows(df.select("order_id", "customer_n_orders", F.round("distance_km_mean", 4).alias("d"), "customer_state"))

    usual = shown()
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert shown() == usual
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_order_joins_share_one_partitioning(spark, smallest_dir):
    """With sort-merge joins, each input of the order facts is shuffled once on order_id and never again."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = plan_of(QUERIES["orders_with_facts"](spark, smallest_dir))
        assert len(re.findall(r"Exchange hashpartitioning\(order_id", plan)) == 4
        assert len(re.findall(r"Exchange", plan)) == 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_hot_order_is_split_before_its_distance_mean(spark, smallest_dir):
    """Two thirds of all items belong to one order; the join is split although a mean per order follows."""
    with skew_settings(spark):
        items = spark.range(0, 200000, 1, 8).select(
            F.when(F.col("id") % 3 < 2, 7).otherwise(F.col("id") % 900).alias("order_id"),
            (F.col("id") * 31 % 5000).alias("seller_id"),
        )
        orders = spark.range(1000).select(F.col("id").alias("order_id"), (F.col("id") % 400).alias("customer_id"))
        customers = spark.range(400).select(F.col("id").alias("customer_id"), (F.col("id") % 900).alias("customer_zip_code_prefix"))
        sellers = spark.range(5000).select(F.col("id").alias("seller_id"), (F.col("id") % 900).alias("seller_zip_code_prefix"))
        places = spark.range(1800).select(
            (F.col("id") % 900).alias("geolocation_zip_code_prefix"), (F.col("id") % 900 * 5.0).alias("geolocation_lat"),
            (F.col("id") % 900 * 3.0).alias("geolocation_lng"),
        )
        distance = features.order_distance(orders, customers, sellers, places, items)
        assert distance.count() == 301
        run = distance.select("*")
        run.collect()
        assert "skew=true" in plan_of(run)


def test_customer_aggregates_do_not_compute_unused_facts(spark, smallest_dir):
    """Payments and distances are one row per order, so the customer branch drops both joins."""
    plan = plan_of(registered.enriched(spark, smallest_dir).select("order_id", "customer_n_orders"))
    assert "mode(" not in plan and "ASIN" not in plan


def test_hot_customer_is_split_by_adaptive_execution(spark, smallest_dir):
    """One customer holds most orders; the join on customer_id is planned with skewed partitions split."""
    with skew_settings(spark):
        ids = spark.range(0, 60000, 1, 8)
        hot = F.when(F.col("id") % 3 < 2, 7).otherwise(F.col("id") % 900)
        orders = ids.select(
            F.col("id").alias("order_id"), hot.alias("customer_id"), F.rand(1).alias("total_order_value"),
            F.timestamp_micros("id").cast("timestamp_ntz").alias("order_purchase_timestamp"),
        )
        customers = ids.select((F.col("id") % 1000).alias("customer_id"), F.col("id").cast("string").alias("name"))
        with_value, _ = features.add_customer_value(orders, unique_orders=True)
        with_attributes = lookup_join(orders, keep_first(customers, ["customer_id"]), "customer_id")
        for joined in (with_value.select("order_id", "total_order_value", "customer_n_orders"), with_attributes):
            assert joined.collect() and "skew=true" in plan_of(joined)
        wrong = with_value.groupBy("customer_id", "customer_n_orders").agg(F.count(F.lit(1)).alias("n"))
        assert wrong.where("n <> customer_n_orders").count() == 0


def test_absent_columns(spark):
    orders = spark.createDataFrame([(1,)], "order_id int")
    row = dashboard.dashboard_kpis(orders).first()
    assert tuple(row) == (0.0, 1, None, None)
    shown = dashboard.refresh(orders, orders, orders)
    assert shown.delay_by_state is None and shown.review_scores is None and shown.delay_vs_review is None
    assert shown.top_customers.count() == 0
    assert reports.dashboard_kpi_table(dashboard.dashboard_kpis(orders.limit(0))).collect()[2]["Value"] == "-"


def test_filter_bounds(spark, rows):
    orders = spark.sql("""select * from values
        (1, 'A', timestamp_ntz'2020-01-01 00:00:00'), (2, 'A', timestamp_ntz'2020-01-02 00:00:00'),
        (3, 'B', timestamp_ntz'2020-01-02 00:00:01'), (4, null, null) as t(order_id, customer_state, order_purchase_timestamp)""")

    def ids(**chosen):
        return [r[0] for r in rows(dashboard.filter_orders(orders, **chosen))]

    assert ids() == [1, 2, 3, 4]
    assert ids(states=["A"]) == [1, 2]
    assert ids(start="2020-01-01", end="2020-01-02") == [1, 2]
    assert ids(start="2020-01-01") == [1, 2, 3, 4]
    assert ids(states=["B"], start="2020-01-01", end="2020-01-03") == [3]


def test_identifiers_in_one_type(spark):
    orders = spark.createDataFrame([(1, 2, "x")], "order_id int, customer_id bigint, order_status string")
    assert set(dict(cleaning.cast_identifiers(orders, "orders").dtypes).values()) == {"string"}


def test_payment_types_are_counted_without_a_map_for_each_order(spark):
    payments = spark.createDataFrame(
        [(1, "b", 1, 2.0), (1, "a", 2, 3.0), (1, None, 9, 1.0), (1, None, 1, None), (1, None, 1, None), (2, "c", 1, 1.0), (2, "b", 1, 1.0),
         (2, "b", 1, 1.0), (3, None, None, None), (None, "a", 1, 1.0)],
        "order_id long, payment_type string, payment_installments int, payment_value double",
    )
    totals = assembly.payment_totals(payments)
    plan = plan_of(totals)
    assert "ObjectHashAggregate" not in plan and plan.count("Exchange") == 1
    assert sorted(tuple(r) for r in totals.collect()) == [(1, 6.0, "a", 9), (2, 3.0, "b", 1), (3, 0.0, None, None)]
