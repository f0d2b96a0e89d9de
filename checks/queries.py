"""One registered query per operator, each over the whole tables of a star-schema folder."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopgrain.functions import number_or_null, timestamp_or_null
from shopgrain.ml import (
    add_class_weights, best_threshold, binary_summary, build_delay_dataset, build_review_dataset, class_weights,
    classification_report, confusion_matrix, delay_estimators, fit_preprocessor, regression_metrics,
    report_summary, roc_auc, threshold_curve, train_binary_review_models, train_customer_value_model,
    train_delay_models, train_review_models,
)
from shopgrain.ml.boosting import Boosting, fit
from shopgrain.ml.forest import ForestSettings, fit_forest
from shopgrain.ml.prepare import category_dictionary, category_modes, category_positions, numeric_constants
from shopgrain.operators import (
    at_or_above_quantile, box_outliers, box_stats, correlation_matrix, count_by, exact_quantiles, exact_sample, fill_domain,
    hash_split, histogram, keep_first, lookup_join, missingness, stratified_split, table_profile, top_k,
)
from shopgrain.plans import assembly, cleaning, cube, dashboard, features, incremental, reports
from shopgrain.plans.workflow import prepare_tables, run_workflow
from shopgrain.schemas import TABLE_COLUMNS
from shopgrain.session import configure, materialize, name_local_folder, stage_path
from shopgrain.sources import (
    SourceEmptyError, SourceMissingError, coerce_counted, load_enriched_orders, load_optional, load_star_schema, load_tables, open_bucketed, scan_csv,
    with_declared_types, write_bucketed, write_enriched_orders, write_top_tables,
)
from shopgrain.sources.star_schema import view

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

# One choice of dashboard filters.
STATES = ("NATION_1", "NATION_3", "NATION_7", "NATION_12", "NATION_20")
START, END = "1996-01-01", "1998-06-30 12:00:00"

INSIDE_DAYS = "1994-02-03 10:30:00", "1997-05-06 07:08:09"

BUCKETS = 8

CORRELATED = (
    "items_price_sum", "freight_value_sum", "payment_value_sum", "delivery_time_days", "delivery_estimated_days",
    "delivery_delay_days", "n_items", "review_score_latest",
)


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(name_local_folder(configure(spark)), sf_dir)

    QUERIES[fn.__name__] = run
    return fn


def rounded(df: DataFrame, places: int = 6, **other: int) -> DataFrame:
    """Doubles to fixed decimals, so that two engines agree on sums taken in different order."""
    return df.select(*[
        F.round(name, other.get(name, places)).alias(name) if dtype == "double" else F.col(name)
        for name, dtype in df.dtypes
    ])


def raw(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return load_star_schema(spark, sf_dir, names or None)


def clean(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return cleaning.clean_tables(raw(spark, sf_dir, *names))


def prepared(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return prepare_tables(raw(spark, sf_dir))


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enriched orders as one lazy plan: queries that use few columns stay narrow."""
    return features.build_enriched_orders(prepared(spark, sf_dir))


def staged_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enriched orders for uses of all columns: the order facts are computed once."""
    return features.build_enriched_orders(prepared(spark, sf_dir), stage=materialize)


def base_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.build_base_orders(prepared(spark, sf_dir))[0]


def order_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with item totals, calendar and money features."""
    tables = clean(spark, sf_dir, "orders", "order_items")
    return (
        tables["orders"].join(assembly.item_totals(tables["order_items"]), "order_id", "left")
        .transform(features.add_time_features)
        .transform(features.add_monetary_features)
    )


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with delivery features and the latest review score."""
    tables = clean(spark, sf_dir, "orders", "reviews")
    return tables["orders"].transform(features.add_delivery_features).join(
        assembly.review_summary(tables["reviews"]), "order_id", "left"
    )


# Sources and sinks -----------------------------------------------------------------------------------------


@query
def csv_tables_profile(spark, sf_dir):
    """All nine tables written as CSV, scanned back by the loader and profiled."""
    base = stage_path(spark, "csv")
    for name, table in raw(spark, sf_dir).items():
        table.write.option("header", True).option("escape", '"').csv(f"{base}/{name}.csv")
    return table_profile(load_tables(spark, base))


@query
def csv_orders_scan(spark, sf_dir):
    """The order table through a CSV file: text coerced to the declared types."""
    path = stage_path(spark, "csv")
    raw(spark, sf_dir, "orders")["orders"].write.option("header", True).csv(path)
    return with_declared_types(scan_csv(spark, path), TABLE_COLUMNS["orders"])


@query
def enriched_orders_reload(spark, sf_dir):
    """Enriched orders written to Parquet by month and read back with missing delays as zero."""
    path = stage_path(spark, "enriched")
    write_enriched_orders(staged_enriched(spark, sf_dir), path, partition_by_month=True)
    back = load_enriched_orders(spark, path)
    return rounded(back.select(
        "order_id", "purchase_year", "purchase_month", "delivery_delay_days", "total_order_value", "customer_state"
    ))


@query
def enriched_orders_csv_reload(spark, sf_dir):
    """Enriched orders written to CSV and read back with declared types."""
    path = stage_path(spark, "enriched")
    write_enriched_orders(staged_enriched(spark, sf_dir), path, fmt="csv")
    back = load_enriched_orders(spark, path, fmt="csv")
    return rounded(back.select(
        F.col("order_id").cast("bigint").alias("order_id"), "order_purchase_timestamp", "delivery_delay_days",
        "is_late", "n_items", "review_score_latest", "payment_type_mode",
    ))


@query
def top_tables_export(spark, sf_dir):
    """The two top-ten tables, exported as CSV and read back for the dashboard."""
    tables = prepared(spark, sf_dir)
    base = stage_path(spark, "top")
    paths = write_top_tables(
        reports.top_categories(tables["order_items"], tables["products"]),
        reports.top_sellers(tables["order_items"]), base,
    )
    categories = load_optional(
        spark, paths["categories"], "product_category_name_english string, revenue double, n_items bigint"
    )
    sellers = load_optional(spark, paths["sellers"], "seller_id string, revenue double, n_items bigint")
    return rounded(
        categories.select(F.lit("category").alias("ranking"), F.col("product_category_name_english").alias("name"),
                          "revenue", "n_items")
        .unionByName(sellers.select(F.lit("seller").alias("ranking"), F.col("seller_id").alias("name"),
                                    "revenue", "n_items")), 2)


@query
def workflow_export(spark, sf_dir):
    """The whole run with staged facts: months of the exported enriched orders."""
    paths = run_workflow(spark, raw(spark, sf_dir), stage_path(spark, "run"))
    orders = load_enriched_orders(spark, paths["enriched_orders"])
    return rounded(reports.monthly_orders_and_revenue(orders), 4)


@query
def incremental_export(spark, sf_dir):
    """Enriched orders after three instalments, of which the last repeats a month of the first."""
    tables = prepared(spark, sf_dir)
    base = stage_path(spark, "instalments")
    year, month = F.year("order_purchase_timestamp"), F.month("order_purchase_timestamp")
    for part in (year <= 1994, year.between(1995, 1996), (year >= 1997) | ((year == 1993) & (month == 5))):
        incremental.export_instalment(spark, {**tables, "orders": tables["orders"].where(part)}, base)
    orders = incremental.load_export(spark, base, tables["customers"])
    return rounded(orders.select(
        "order_id", "customer_id", "purchase_year", "purchase_month", "total_order_value", "delivery_delay_days", "n_items",
        "review_score_latest", "customer_n_orders", "customer_total_revenue", "customer_avg_order_value",
        "customer_last_purchase", "customer_review_score_mean", "customer_review_count", "customer_state",
    ), 6, customer_avg_order_value=8)


@query
def tables_profile(spark, sf_dir):
    return table_profile(raw(spark, sf_dir))


# Cleaning --------------------------------------------------------------------------------------------------


@query
def coerced_raw_orders(spark, sf_dir):
    """Unreadable dates and amounts become NULL."""
    return view(spark, sf_dir, "raw_orders").select(
        "order_id",
        timestamp_or_null(F.col("purchase_text")).alias("purchase_ts"),
        number_or_null(F.col("price_text")).alias("price"),
    )


def counted_raw_orders(spark, sf_dir):
    text = view(spark, sf_dir, "raw_orders")
    return coerce_counted(text, {"purchase_text": "timestamp_ntz", "price_text": "double"}, ["order_id"], materialize)


@query
def coercion_report(spark, sf_dir):
    """How many values were given and how many could not be read, observed while the typed rows were written."""
    return counted_raw_orders(spark, sf_dir).report


@query
def coercion_rejects(spark, sf_dir):
    return counted_raw_orders(spark, sf_dir).rejects


@query
def identifier_typing(spark, sf_dir):
    return cleaning.cast_identifiers(raw(spark, sf_dir, "orders")["orders"], "orders").select(
        "order_id", "customer_id", "order_status"
    )


@query
def first_item_per_key(spark, sf_dir):
    """Keep-first on a composite key that repeats."""
    return keep_first(raw(spark, sf_dir, "order_items")["order_items"], ["order_id", "order_item_id"])


@query
def cleaned_orders(spark, sf_dir):
    return clean(spark, sf_dir, "orders")["orders"]


@query
def cleaned_customers(spark, sf_dir):
    return clean(spark, sf_dir, "customers")["customers"]


@query
def latest_reviews(spark, sf_dir):
    return clean(spark, sf_dir, "reviews")["reviews"]


@query
def complete_raw_orders(spark, sf_dir):
    """Rows whose required time could not be read are dropped."""
    typed = coerced_raw_orders(spark, sf_dir)
    renamed = typed.withColumnRenamed("purchase_ts", "order_purchase_timestamp").withColumn(
        "customer_id", F.col("order_id")
    )
    return cleaning.drop_incomplete(renamed, "orders")


@query
def translated_products(spark, sf_dir):
    return prepared(spark, sf_dir)["products"]


# Assembly --------------------------------------------------------------------------------------------------


@query
def order_item_totals(spark, sf_dir):
    return rounded(assembly.item_totals(clean(spark, sf_dir, "order_items")["order_items"]))


@query
def order_payment_totals(spark, sf_dir):
    return rounded(assembly.payment_totals(clean(spark, sf_dir, "payments")["payments"]))


@query
def order_review_summary(spark, sf_dir):
    return assembly.review_summary(clean(spark, sf_dir, "reviews")["reviews"])


@query
def orders_with_customers(spark, sf_dir):
    tables = clean(spark, sf_dir, "orders", "customers")
    return assembly.attach_customers(tables["orders"], tables["customers"])


@query
def orders_with_facts(spark, sf_dir):
    tables = clean(spark, sf_dir, "orders", "order_items", "payments", "reviews")
    return rounded(assembly.attach_order_facts(tables["orders"], tables))


def bucketed_facts(spark, sf_dir):
    """Order facts over tables that were written in buckets and opened again."""
    base = stage_path(spark, "buckets")
    write_bucketed(raw(spark, sf_dir, "orders", "order_items", "payments", "reviews"), base, BUCKETS)
    tables = cleaning.clean_tables(open_bucketed(spark, base, BUCKETS))
    return assembly.attach_order_facts(tables["orders"], tables)


@query
def orders_with_facts_from_buckets(spark, sf_dir):
    return rounded(bucketed_facts(spark, sf_dir))


@query
def base_order_table(spark, sf_dir):
    return rounded(base_orders(spark, sf_dir))


@query
def extended_items(spark, sf_dir):
    tables = prepared(spark, sf_dir)
    return rounded(assembly.build_base_orders(tables)[1])


@query
def items_with_sellers(spark, sf_dir):
    tables = clean(spark, sf_dir, "order_items", "sellers")
    return rounded(lookup_join(tables["order_items"], tables["sellers"], "seller_id"))


# Features --------------------------------------------------------------------------------------------------


@query
def time_features(spark, sf_dir):
    return features.add_time_features(clean(spark, sf_dir, "orders")["orders"]).select(
        "order_id", "purchase_year", "purchase_month", "purchase_day", "purchase_weekday", "purchase_hour",
        "is_weekend", "order_purchase_date",
    )


@query
def delivery_features(spark, sf_dir):
    return rounded(features.add_delivery_features(clean(spark, sf_dir, "orders")["orders"]).select(
        "order_id", "delivery_time_days", "delivery_estimated_days", "delivery_delay_days", "is_late"
    ))


@query
def monetary_features(spark, sf_dir):
    return rounded(order_values(spark, sf_dir).select(
        "order_id", "n_items", "items_price_sum", "freight_value_sum", "total_order_value", "avg_item_price"
    ))


@query
def interaction_features(spark, sf_dir):
    """Missing delay or value counts as zero."""
    orders = order_values(spark, sf_dir).transform(features.add_delivery_features)
    return rounded(features.add_interaction_features(orders).select(
        "order_id", "freight_to_price_ratio", "delay_x_total_value"
    ), 6, delay_x_total_value=7)


@query
def interaction_features_keep_missing(spark, sf_dir):
    orders = order_values(spark, sf_dir).transform(features.add_delivery_features)
    return rounded(features.add_interaction_features(orders, missing_as_zero=False).select(
        "order_id", "freight_to_price_ratio", "delay_x_total_value"
    ), 6, delay_x_total_value=7)


@query
def binary_review_target(spark, sf_dir):
    return features.add_binary_review_target(deliveries(spark, sf_dir)).select(
        "order_id", "review_score_latest", "review_binary"
    )


@query
def customer_value_table(spark, sf_dir):
    return rounded(features.customer_value(order_values(spark, sf_dir)), 6, customer_avg_order_value=8)


@query
def orders_with_customer_value(spark, sf_dir):
    orders, _ = features.add_customer_value(order_values(spark, sf_dir), unique_orders=True)
    return rounded(orders.select(
        "order_id", "customer_id", "customer_n_orders", "customer_total_revenue", "customer_avg_order_value",
        "customer_last_purchase",
    ), 6, customer_avg_order_value=8)


@query
def product_review_stats(spark, sf_dir):
    tables = clean(spark, sf_dir, "order_items", "reviews")
    return rounded(features.product_and_seller_review_stats(tables["order_items"], tables["reviews"])[0])


@query
def seller_review_stats(spark, sf_dir):
    tables = clean(spark, sf_dir, "order_items", "reviews")
    return rounded(features.product_and_seller_review_stats(tables["order_items"], tables["reviews"])[1])


@query
def orders_with_customer_reviews(spark, sf_dir):
    tables = clean(spark, sf_dir, "order_items", "reviews")
    orders, _, _ = features.add_review_aggregates(
        deliveries(spark, sf_dir), tables["order_items"], tables["reviews"]
    )
    return rounded(orders.select("order_id", "customer_id", "customer_review_score_mean", "customer_review_count"))


@query
def zip_centroids(spark, sf_dir):
    return rounded(features.zip_centroids(raw(spark, sf_dir, "geolocation")["geolocation"]), 9)


@query
def customer_positions(spark, sf_dir):
    tables = clean(spark, sf_dir, "customers", "geolocation")
    return rounded(features.place(tables["customers"], "customer", features.zip_centroids(tables["geolocation"])), 9)


@query
def seller_positions(spark, sf_dir):
    tables = clean(spark, sf_dir, "sellers", "geolocation")
    return rounded(features.place(tables["sellers"], "seller", features.zip_centroids(tables["geolocation"])), 9)


@query
def order_distances(spark, sf_dir):
    tables = clean(spark, sf_dir)
    return rounded(features.order_distance(
        tables["orders"], tables["customers"], tables["sellers"], tables["geolocation"], tables["order_items"]
    ), 4)


@query
def orders_with_distance(spark, sf_dir):
    tables = clean(spark, sf_dir)
    return rounded(features.add_distance(
        tables["orders"], tables["customers"], tables["sellers"], tables["geolocation"], tables["order_items"]
    ).select("order_id", "distance_km_mean"), 4)


@query
def enriched_orders(spark, sf_dir):
    return rounded(staged_enriched(spark, sf_dir), 6, customer_avg_order_value=8, distance_km_mean=4, delay_x_total_value=7)


# Reports ---------------------------------------------------------------------------------------------------


@query
def monthly_orders_revenue(spark, sf_dir):
    return rounded(reports.monthly_orders_and_revenue(order_values(spark, sf_dir)), 4)


@query
def top_categories(spark, sf_dir):
    tables = prepared(spark, sf_dir)
    return rounded(reports.top_categories(tables["order_items"], tables["products"]), 2)


@query
def top_sellers(spark, sf_dir):
    return rounded(reports.top_sellers(clean(spark, sf_dir, "order_items")["order_items"]), 4)


@query
def top_five_of_rankings(spark, sf_dir):
    """The shortest of the nested rankings: best five of the best ten of the best fifteen."""
    tables = prepared(spark, sf_dir)
    key = "product_category_name_english"
    best = reports.top_categories(tables["order_items"], tables["products"], 15)
    best_sellers = reports.top_sellers(tables["order_items"], 15)
    five = top_k(top_k(best, "revenue", key, 10), "revenue", key, 5)
    five_sellers = top_k(top_k(best_sellers, "revenue", "seller_id", 10), "revenue", "seller_id", 5)
    return rounded(
        five.select(F.lit("category").alias("ranking"), F.col(key).alias("name"), "revenue")
        .unionByName(five_sellers.select(
            F.lit("seller").alias("ranking"), F.col("seller_id").cast("string").alias("name"), "revenue"
        )), 2)


@query
def top_customers(spark, sf_dir):
    return rounded(reports.top_customers(features.customer_value(order_values(spark, sf_dir))), 4)


@query
def labelled_top_customers(spark, sf_dir):
    orders, _ = features.add_customer_value(order_values(spark, sf_dir), unique_orders=True)
    return rounded(reports.top_customers_of_orders(orders), 4)


@query
def error_by_state(spark, sf_dir):
    tables = clean(spark, sf_dir, "orders", "customers")
    return rounded(reports.error_by_state(regression_rows(tables), "actual", "predicted"))


@query
def business_kpis(spark, sf_dir):
    orders = enriched(spark, sf_dir)
    return rounded(reports.business_kpis(orders), 6, total_revenue=2)


@query
def kpi_table(spark, sf_dir):
    return reports.kpi_table(reports.business_kpis(enriched(spark, sf_dir), unique_orders=True))


@query
def high_value_customers(spark, sf_dir):
    """Customers at or above the 95th percentile of revenue."""
    value = materialize(features.customer_value(order_values(spark, sf_dir), unique_orders=True))
    return rounded(at_or_above_quantile(value, "customer_total_revenue", 0.95), 6, customer_avg_order_value=8)


@query
def customer_value_as_of_order(spark, sf_dir):
    """Value of the customer's strictly earlier orders, per order."""
    return rounded(features.customer_value_as_of_order(order_values(spark, sf_dir)), 6, customer_prior_avg_order_value=8)


@query
def interaction_features_of_few_columns(spark, sf_dir):
    """Orders without freight and delay: one form has the columns as zero, the other leaves them out."""
    orders = order_values(spark, sf_dir).select("order_id", "items_price_sum")
    filled, left = (features.add_interaction_features(orders, missing_as_zero=zero) for zero in (True, False))
    return rounded(filled.withColumn("columns_left_out", F.lit(len(filled.columns) - len(left.columns))))


@query
def source_guards(spark, sf_dir):
    """What loading says of an empty table, a missing one, a missing export and an optional table never written."""
    base = stage_path(spark, "guards")
    for name, rows in raw(spark, sf_dir).items():
        rows.where(F.lit(name != "sellers")).write.parquet(f"{base}/{name}.parquet")

    def outcome(action):
        try:
            return str(action())
        except (SourceEmptyError, SourceMissingError) as error:
            return type(error).__name__

    return spark.createDataFrame([
        ("empty table", outcome(lambda: load_tables(spark, base, "parquet"))),
        ("empty table allowed", outcome(lambda: load_tables(spark, base, "parquet", require_rows=False)["sellers"].count())),
        ("table beside it", outcome(lambda: load_tables(spark, base, "parquet", require_rows=False)["orders"].count())),
        ("missing table", outcome(lambda: load_tables(spark, f"{base}/none", "parquet"))),
        ("missing export", outcome(lambda: load_enriched_orders(spark, f"{base}/none"))),
        ("optional table", outcome(lambda: load_optional(spark, f"{base}/none", "seller_id string, revenue double").count())),
    ], "given string, outcome string")


@query
def customers_with_zero_filled_value(spark, sf_dir):
    """Every known customer, those without delivered orders with zero orders and revenue."""
    delivered = order_values(spark, sf_dir).where(F.col("order_delivered_customer_date").isNotNull())
    customers = clean(spark, sf_dir, "customers")["customers"]
    return rounded(
        features.customer_value(delivered, unique_orders=True, domain=customers), 6, customer_avg_order_value=8
    )


@query
def sales_by_every_key(spark, sf_dir):
    """Five rankings' measures from one scan of the items."""
    tables = prepared(spark, sf_dir)
    orders = assembly.attach_customers(tables["orders"], tables["customers"])
    return rounded(reports.sales_by_every_key(tables["order_items"], tables["products"], orders), 2)


@query
def items_per_category_zero_filled(spark, sf_dir):
    """Item counts over every translated category, sold or not."""
    tables = prepared(spark, sf_dir)
    sales = reports.category_sales(tables["order_items"], tables["products"])
    domain = tables["category_translation"].select("product_category_name_english")
    return rounded(fill_domain(sales, domain, "product_category_name_english", {"revenue": 0.0, "n_items": 0}), 2)


# Dashboard -------------------------------------------------------------------------------------------------


_EXPORTS: dict[tuple[str, str], dict[str, str]] = {}


def exported(spark, sf_dir):
    """Paths of one workflow run over a folder, kept for the session: what a dashboard reads, whatever its filters."""
    key = spark.sparkContext.applicationId, sf_dir
    found = _EXPORTS.get(key)
    if found:
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{found['cells']}/_SUCCESS")
        if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            found = None
    if not found:
        base = stage_path(spark, "run")
        found = run_workflow(spark, raw(spark, sf_dir), base) | {"cells": f"{base}/cells"}
        cube.build_cells(load_enriched_orders(spark, found["enriched_orders"])).write.parquet(found["cells"])
        _EXPORTS[key] = found
    return found


def chosen(spark, sf_dir):
    """The stored enriched table, filtered as a request would."""
    return dashboard.filter_orders(load_enriched_orders(spark, exported(spark, sf_dir)["enriched_orders"]), STATES, START, END)


def chosen_cells(spark, sf_dir, start=START, end=END):
    """The same choice from stored cells; only orders of the last day are read from the wide table."""
    paths = exported(spark, sf_dir)
    orders = load_enriched_orders(spark, paths["enriched_orders"])
    return cube.choose_cells(spark.read.parquet(paths["cells"]), orders, STATES, start, end)


@query
def dashboard_filtered_orders(spark, sf_dir):
    return rounded(chosen(spark, sf_dir).select(
        "order_id", "customer_state", "order_purchase_timestamp", "delivery_delay_days", "total_order_value"
    ))


@query
def dashboard_kpis(spark, sf_dir):
    return rounded(dashboard.dashboard_kpis(chosen(spark, sf_dir)), 6, total_revenue=2)


@query
def dashboard_kpi_table(spark, sf_dir):
    return reports.dashboard_kpi_table(dashboard.dashboard_kpis(chosen(spark, sf_dir), unique_orders=True))


@query
def dashboard_delay_by_state(spark, sf_dir):
    return rounded(dashboard.delay_by_state(chosen(spark, sf_dir)))


@query
def dashboard_top_customers(spark, sf_dir):
    return rounded(reports.top_customers_of_orders(chosen(spark, sf_dir)), 4)


@query
def dashboard_review_scores(spark, sf_dir):
    return dashboard.review_score_counts(chosen(spark, sf_dir))


@query
def dashboard_delay_vs_review(spark, sf_dir):
    return rounded(dashboard.delay_review_pairs(chosen(spark, sf_dir)))


@query
def dashboard_refresh(spark, sf_dir):
    """All seven datasets of one refresh over an export, as rows of (dataset, label, value)."""
    shown = dashboard.refresh_export(spark, exported(spark, sf_dir), STATES, START, END)

    def part(name, df, label, value):
        return df.select(
            F.lit(name).alias("dataset"), F.col(label).cast("string").alias("label"),
            F.round(F.col(value).cast("double"), 2).alias("value"),
        )

    kpis = shown.kpis.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("label"), F.col(name).cast("double").alias("value")) for name in shown.kpis.columns
    ])))
    return (
        part("kpis", kpis, "label", "value")
        .unionByName(part("top_categories", shown.top_categories, "product_category_name_english", "n_items"))
        .unionByName(part("top_sellers", shown.top_sellers, "seller_id", "n_items"))
        .unionByName(part("delay_by_state", shown.delay_by_state, "customer_state", "avg_delay"))
        .unionByName(part("top_customers", shown.top_customers, "customer_id", "customer_total_revenue"))
        .unionByName(part("review_scores", shown.review_scores, "review_score_latest", "n_orders"))
        .unionByName(part("delay_vs_review", shown.delay_vs_review, "order_id", "delivery_delay_days"))
    )


@query
def cube_kpis(spark, sf_dir):
    return rounded(cube.kpis_of(chosen_cells(spark, sf_dir)), 6, total_revenue=2)


@query
def cube_delay_by_state(spark, sf_dir):
    return rounded(cube.delay_by_state_of(chosen_cells(spark, sf_dir)))


@query
def cube_review_scores(spark, sf_dir):
    return cube.review_scores_of(chosen_cells(spark, sf_dir))


@query
def cube_kpis_inside_days(spark, sf_dir):
    """Both bounds inside a day."""
    return rounded(cube.kpis_of(chosen_cells(spark, sf_dir, *INSIDE_DAYS)), 6, total_revenue=2)


@query
def state_options(spark, sf_dir):
    tables = clean(spark, sf_dir, "orders", "customers")
    return dashboard.state_options(assembly.attach_customers(tables["orders"], tables["customers"]))


@query
def date_bounds(spark, sf_dir):
    return dashboard.date_bounds(clean(spark, sf_dir, "orders")["orders"])


# Chart datasets --------------------------------------------------------------------------------------------


@query
def base_missingness(spark, sf_dir):
    return missingness(base_orders(spark, sf_dir))


@query
def customers_by_state(spark, sf_dir):
    return count_by(clean(spark, sf_dir, "customers")["customers"], "customer_state", "n_customers")


@query
def payments_by_type(spark, sf_dir):
    return count_by(clean(spark, sf_dir, "payments")["payments"], "payment_type", "n_payments")


@query
def item_sum_histogram(spark, sf_dir):
    return rounded(histogram(order_values(spark, sf_dir), "items_price_sum", stage=materialize), 4)


@query
def freight_sum_histogram(spark, sf_dir):
    return rounded(histogram(order_values(spark, sf_dir), "freight_value_sum", stage=materialize), 4)


@query
def delay_histogram(spark, sf_dir):
    return rounded(histogram(deliveries(spark, sf_dir), "delivery_delay_days", stage=materialize))


@query
def review_score_counts(spark, sf_dir):
    return dashboard.review_score_counts(deliveries(spark, sf_dir))


@query
def delay_box_by_score(spark, sf_dir):
    return rounded(box_stats(deliveries(spark, sf_dir), "delivery_delay_days", "review_score_latest"))


@query
def delay_outliers_by_score(spark, sf_dir):
    return rounded(box_outliers(
        deliveries(spark, sf_dir), "delivery_delay_days", "review_score_latest", reach=0.5
    ))


@query
def price_quantiles_by_product(spark, sf_dir):
    """Quartiles of the price of every product: as many groups as there are products."""
    items = clean(spark, sf_dir, "order_items")["order_items"]
    return rounded(exact_quantiles(items, "price", {"q1": 0.25, "median": 0.5, "q3": 0.75}, ["product_id"]))


@query
def correlation_of_order_facts(spark, sf_dir):
    return rounded(correlation_matrix(base_with_delivery(spark, sf_dir), CORRELATED))


def base_with_delivery(spark, sf_dir):
    tables = clean(spark, sf_dir, "orders", "order_items", "payments", "reviews")
    return (
        assembly.attach_order_facts(tables["orders"], tables)
        .transform(features.add_monetary_features)
        .transform(features.add_delivery_features)
    )


@query
def price_freight_sample(spark, sf_dir):
    """20,000 items in hash order, by all columns since the item key repeats."""
    items = clean(spark, sf_dir, "order_items")["order_items"]
    sample = exact_sample(items, 20_000, ["order_id", "order_item_id", "product_id", "seller_id"], stage=materialize)
    return rounded(sample.select("order_id", "order_item_id", "product_id", "seller_id", "price", "freight_value"))


@query
def pair_plot_sample(spark, sf_dir):
    """2,000 orders with all correlated columns present."""
    complete = base_with_delivery(spark, sf_dir).select("order_id", *CORRELATED).dropna()
    return rounded(exact_sample(materialize(complete), 2_000, ["order_id"], stage=materialize))


# Splits and preprocessing ----------------------------------------------------------------------------------


@query
def holdout_split(spark, sf_dir):
    return hash_split(clean(spark, sf_dir, "orders")["orders"].select("order_id"), ["order_id"])


@query
def stratified_review_split(spark, sf_dir):
    reviews = clean(spark, sf_dir, "reviews")["reviews"].select("order_id", "review_score")
    return stratified_split(reviews, ["order_id"], "review_score")


@query
def delay_dataset(spark, sf_dir):
    spec = features.FEATURE_SETS["delay"]
    return rounded(build_delay_dataset(staged_enriched(spark, sf_dir), spec.inputs), 6, distance_km_mean=4)


@query
def review_dataset(spark, sf_dir):
    spec = features.FEATURE_SETS["review"]
    return rounded(
        build_review_dataset(staged_enriched(spark, sf_dir), spec.inputs), 6, distance_km_mean=4, delay_x_total_value=7
    )


def delay_training_rows(spark, sf_dir):
    spec = features.FEATURE_SETS["delay"]
    rows = materialize(build_delay_dataset(staged_enriched(spark, sf_dir), spec.inputs))
    return spec, rows, rows.where("split = 'train'")


@query
def numeric_preprocessing_constants(spark, sf_dir):
    spec, _, train = delay_training_rows(spark, sf_dir)
    return rounded(numeric_constants(train, spec.numeric), 4)


@query
def categorical_preprocessing_constants(spark, sf_dir):
    spec, _, train = delay_training_rows(spark, sf_dir)
    return category_modes(train, spec.categorical)


@query
def scaled_delay_features(spark, sf_dir):
    """Imputed and standardised numeric features of all rows, with constants from the training rows."""
    spec, rows, train = delay_training_rows(spark, sf_dir)
    fitted = fit_preprocessor(train, spec.numeric, [])
    return rounded(rows.select("order_id", "split", *[fitted.scaled(name).alias(name) for name in spec.numeric]), 5)


@query
def one_hot_delay_features(spark, sf_dir):
    """Assembled vectors of all rows: the ones of the categorical part, counted per category position."""
    from pyspark.ml.functions import vector_to_array

    spec, rows, train = delay_training_rows(spark, sf_dir)
    model = fit_preprocessor(train, [], spec.categorical).pipeline().fit(train)
    positions = model.transform(rows).select("split", F.posexplode(vector_to_array("features")).alias("position", "on"))
    return positions.where("on = 1.0").groupBy("split", "position").agg(F.count(F.lit(1)).alias("n_rows"))


@query
def one_hot_delay_positions(spark, sf_dir):
    """The same counts from a dictionary that is numbered on the executors."""
    spec, rows, train = delay_training_rows(spark, sf_dir)
    dictionary = materialize(category_dictionary(train, spec.categorical, materialize))
    modes = category_modes(train, spec.categorical).first().asDict()
    placed = category_positions(rows, ["order_id", "split"], spec.categorical, dictionary, modes)
    return placed.select("split", F.explode("positions").alias("position")).groupBy("split", "position").agg(F.count(F.lit(1)).alias("n_rows"))


@query
def review_class_weights(spark, sf_dir):
    return rounded(class_weights(clean(spark, sf_dir, "reviews")["reviews"], "review_score"))


# Evaluation ------------------------------------------------------------------------------------------------


def regression_rows(tables):
    """Predictions of known form, attached to order and state."""
    orders = assembly.attach_customers(tables["orders"], tables["customers"])
    return orders.select(
        "order_id", "customer_state",
        (F.col("order_id") % 50 / 10.0).alias("actual"), (F.col("order_id") % 47 / 10.0).alias("predicted"),
    )


def class_rows(spark, sf_dir):
    return raw(spark, sf_dir, "reviews")["reviews"].select(
        F.col("review_score").alias("label"),
        ((F.col("review_score") + F.col("review_id") % 3) % 5 + 1).cast("int").alias("prediction"),
    )


@query
def regression_quality(spark, sf_dir):
    tables = clean(spark, sf_dir, "orders", "customers")
    return rounded(regression_metrics(regression_rows(tables), "actual", "predicted"))


@query
def actual_vs_predicted(spark, sf_dir):
    tables = clean(spark, sf_dir, "orders", "customers")
    pairs = regression_rows(tables)
    return rounded(pairs.withColumn("abs_error", F.abs(F.col("actual") - F.col("predicted"))))


@query
def score_classification_report(spark, sf_dir):
    return rounded(classification_report(class_rows(spark, sf_dir)))


@query
def score_report_summary(spark, sf_dir):
    return rounded(report_summary(classification_report(class_rows(spark, sf_dir))))


@query
def score_confusion_matrix(spark, sf_dir):
    return confusion_matrix(class_rows(spark, sf_dir))


@query
def quality_roc_auc(spark, sf_dir):
    return rounded(roc_auc(view(spark, sf_dir, "scores"), stage=materialize))


@query
def quality_threshold_curve(spark, sf_dir):
    return rounded(threshold_curve(view(spark, sf_dir, "scores")))


@query
def quality_best_threshold(spark, sf_dir):
    return rounded(best_threshold(threshold_curve(view(spark, sf_dir, "scores"))))


@query
def quality_binary_summary(spark, sf_dir):
    rows = view(spark, sf_dir, "scores").withColumn("prediction", (F.col("score") >= 0.5).cast("int"))
    return rounded(binary_summary(rows, tune_threshold=True))


# Boosted trees, tree by tree: few rounds over all rows, so that the twin can grow the same ones ---------------


@dataclass(frozen=True)
class Task:
    """Inputs and settings that a query of boosted trees and its twin share."""

    objective: str
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    settings: Boosting
    classes: tuple[int, ...] = ()


BOOSTED = {
    "review_softmax_scores": Task(
        "softmax", features.FEATURE_SETS["review"].numeric, features.FEATURE_SETS["review"].categorical,
        Boosting(rounds=3, depth=3), (1, 2, 3, 4, 5),
    ),
    "satisfaction_boosted_scores": Task(
        "logistic", features.FEATURE_SETS["review"].numeric, features.FEATURE_SETS["review"].categorical,
        Boosting(rounds=4, depth=3, rate=0.3, rows=0.8, columns=0.6),
    ),
    "delay_boosted_scores": Task(
        "squared", features.FEATURE_SETS["delay"].numeric, features.FEATURE_SETS["delay"].categorical,
        Boosting(rounds=3, depth=4, rate=0.3, columns=0.8, stage_every=2),
    ),
}


def boosted_scores(name: str, rows: DataFrame, balanced: bool) -> DataFrame:
    """Test rows scored by trees fitted to the training rows."""
    task, rows = BOOSTED[name], materialize(rows)
    train = rows.where("split = 'train'")
    train = add_class_weights(train) if balanced else train
    model = fit(
        train, ["order_id"], task.numeric, task.categorical, task.objective, task.settings,
        weight="class_weight" if balanced else None,
    )
    return model.transform(rows.where("split = 'test'"))


@query
def review_softmax_scores(spark, sf_dir):
    """Probabilities of the five scores from one softmax."""
    scored = boosted_scores("review_softmax_scores", review_dataset(spark, sf_dir), balanced=True)
    return scored.select(
        "order_id", "label", "prediction", *[F.round(F.col("probabilities")[k], 6).alias(f"p{k + 1}") for k in range(5)]
    )


@query
def satisfaction_boosted_scores(spark, sf_dir):
    """Probability of a satisfied customer; trees see samples of rows and inputs."""
    rows = review_dataset(spark, sf_dir).withColumn("label", (F.col("label") >= 4).cast("int"))
    scored = boosted_scores("satisfaction_boosted_scores", rows, balanced=True)
    return scored.select("order_id", "label", "prediction", F.round("score", 6).alias("score"))


@query
def delay_boosted_scores(spark, sf_dir):
    """Days of delay, trees on samples of inputs, margins written every other round."""
    scored = boosted_scores("delay_boosted_scores", delay_dataset(spark, sf_dir), balanced=False)
    return scored.select("order_id", "label", F.round("prediction", 6).alias("prediction"))


# A target of 36 levels, each two and a half times the one below: the best cut takes the highest level off, so trees are chains.
CHAIN = ForestSettings(trees=2, bins=255)


def chain_rows(spark, sf_dir):
    orders = clean(spark, sf_dir, "orders")["orders"]
    place = (F.col("order_id") % 36).cast("double")
    rows = orders.select("order_id", place.alias("place"), (F.pow(F.lit(2.5), place) / 1048576).alias("label"))
    return hash_split(rows, ["order_id"])


@query
def deep_forest_scores(spark, sf_dir):
    """Test rows scored by trees deeper than 30 levels."""
    rows = materialize(chain_rows(spark, sf_dir))
    model = fit_forest(rows.where("split = 'train'"), ["order_id"], ["place"], [], CHAIN)
    scored = model.transform(rows.where("split = 'test'"), ["order_id"])
    return scored.select("order_id", F.round("prediction", 3).alias("prediction"), F.lit(model.depth).alias("depth"))


@query
def delay_forest_scores(spark, sf_dir):
    rows = materialize(delay_dataset(spark, sf_dir))
    spec = features.FEATURE_SETS["delay"]
    model = fit_forest(rows.where("split = 'train'"), ["order_id"], spec.numeric, spec.categorical, DELAY_FOREST)
    scored = model.transform(rows.where("split = 'test'"), ["order_id"])
    return rounded(rows.select("order_id", "label").join(scored, "order_id"))


DELAY_FOREST = ForestSettings(trees=3, bins=32, least_rows=20, max_depth=12)


# Models: full rows; metrics of the default models, the other two queries fit smaller ensembles ------------------------------------------------------


@query
def delay_model_metrics(spark, sf_dir):
    spec = features.FEATURE_SETS["delay"]
    dataset = build_delay_dataset(staged_enriched(spark, sf_dir), spec.inputs)
    # Trees without depth limit, as the reference's; they never stand on the driver, as those of Spark's forest would.
    whole = {**delay_estimators(), "RandomForest": ForestSettings()}
    return train_delay_models(dataset, spec.numeric, spec.categorical, whole)[0]


@query
def delay_model_error_by_state(spark, sf_dir):
    """Scored test orders of the forest, with the states it serves worst."""
    spec = features.FEATURE_SETS["delay"]
    dataset = build_delay_dataset(staged_enriched(spark, sf_dir), spec.inputs)
    forest = {"RandomForest": delay_estimators({"RandomForest": 10}, forest_depth=8)["RandomForest"]}
    _, _, scored = train_delay_models(dataset, spec.numeric, spec.categorical, forest)
    return reports.error_by_state(scored, "label", "prediction")


@query
def review_model_metrics(spark, sf_dir):
    spec = features.FEATURE_SETS["review"]
    dataset = build_review_dataset(staged_enriched(spark, sf_dir), spec.inputs)
    return train_review_models(dataset, spec.numeric, spec.categorical)[0]


@query
def satisfaction_model_metrics(spark, sf_dir):
    spec = features.FEATURE_SETS["review"]
    orders = features.add_binary_review_target(staged_enriched(spark, sf_dir))
    return train_binary_review_models(orders, spec.inputs, use_class_weight=True, tune_threshold=True)[0]


@query
def customer_value_model_metrics(spark, sf_dir):
    value = features.customer_value(order_values(spark, sf_dir), unique_orders=True)
    return train_customer_value_model(value, trees=10)[0]
