"""Readers and writers on files in a temporary folder."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shopgrain.plans import run_workflow
from shopgrain.schemas import TABLE_COLUMNS, TABLE_NAMES
from shopgrain.sources import (
    SourceEmptyError, SourceMissingError, load_enriched_orders, load_optional, load_star_schema, load_tables,
    scan_csv, write_enriched_orders, write_small_csv, write_top_tables,
)

FILES = {
    "customers": [
        "customer_id,customer_unique_id,customer_zip_code_prefix,customer_city,customer_state",
        "c1,u1,01409,sao paulo,SP", "c2,u2,13056,campinas,NA"],
    "geolocation": ["geolocation_zip_code_prefix,geolocation_lat,geolocation_lng", "01409,-23.5,-46.6", "1409,bad,-46.8"],
    "orders": [
        "order_id,customer_id,order_status,order_purchase_timestamp,order_approved_at,order_delivered_carrier_date,"
        "order_delivered_customer_date,order_estimated_delivery_date",
        "o1,c1,delivered,2017-10-02 10:56:33,2017-10-02 11:07:15,,2017-10-10 21:25:13,2017-10-18 00:00:00",
        "o2,c2,shipped,not a date,,,,"],
    "order_items": [
        "order_id,order_item_id,product_id,seller_id,shipping_limit_date,price,freight_value",
        "o1,1,p1,s1,2017-10-06 11:07:15,29.99,8.72", "o1,2,p1,s1,null,oops,1.28"],
    "payments": ["order_id,payment_sequential,payment_type,payment_installments,payment_value", "o1,1,voucher,1,38.71"],
    "reviews": [
        "review_id,order_id,review_score,review_comment_message,review_creation_date,review_answer_timestamp",
        'r1,o1,4,"two lines', 'with ""quotes"", and a comma",2017-10-11 00:00:00,2017-10-12 03:43:48'],
    "products": ["product_id,product_category_name", "p1,"],
    "sellers": ["seller_id,seller_zip_code_prefix,seller_city,seller_state", "s1,13023,campinas,SP"],
    "category_translation": ["product_category_name,product_category_name_english", "beleza,beauty"],
}


@pytest.fixture
def csv_dir(tmp_path):
    for name, lines in FILES.items():
        (tmp_path / f"{name}.csv").write_text("\n".join(lines) + "\n")
    return tmp_path


def test_load_csv_tables(spark, csv_dir, rows):
    tables = load_tables(spark, str(csv_dir))
    assert tuple(tables) == TABLE_NAMES
    for name, table in tables.items():
        types = dict(table.dtypes)
        assert {c: types[c] for c in TABLE_COLUMNS[name]} == TABLE_COLUMNS[name]
    # Leading zeros vanish alike in all zip columns; the missing token is NULL; other columns are kept.
    assert rows(tables["customers"]) == [("c1", "u1", 1409, "sao paulo", "SP"), ("c2", "u2", 13056, "campinas", None)]
    assert rows(tables["geolocation"]) == [(1409, -23.5, -46.6), (1409, None, -46.8)]
    review = tables["reviews"].first()
    assert review["review_comment_message"] == 'two lines\nwith "quotes", and a comma'
    assert review["review_answer_timestamp"] == dt.datetime(2017, 10, 12, 3, 43, 48)
    assert [r["price"] for r in tables["order_items"].orderBy("order_item_id").collect()] == [29.99, None]
    assert [r["order_purchase_timestamp"] for r in tables["orders"].orderBy("order_id").collect()] == [
        dt.datetime(2017, 10, 2, 10, 56, 33), None]


def test_parquet_tables_and_paths(spark, csv_dir, tmp_path, rows):
    tables = load_tables(spark, str(csv_dir))
    out = tmp_path / "pq"
    for name, table in tables.items():
        table.write.parquet(str(out / f"{name}.parquet"))
    back = load_tables(spark, str(out), fmt="parquet")
    assert rows(back["orders"]) == rows(tables["orders"])
    moved = tmp_path / "elsewhere.csv"
    moved.write_text("\n".join(FILES["sellers"]).replace("s1", "s9") + "\n")
    assert load_tables(spark, str(csv_dir), paths={"sellers": str(moved)})["sellers"].first()["seller_id"] == "s9"


def test_empty_and_missing_sources(spark, csv_dir):
    (csv_dir / "payments.csv").write_text(FILES["payments"][0] + "\n")
    with pytest.raises(SourceEmptyError, match="payments"):
        load_tables(spark, str(csv_dir))
    assert load_tables(spark, str(csv_dir), require_rows=False)["payments"].count() == 0
    with pytest.raises(SourceMissingError, match="no data at"):
        load_tables(spark, str(csv_dir / "nowhere"))
    with pytest.raises(SourceMissingError):
        load_enriched_orders(spark, str(csv_dir / "nowhere"))


def test_optional_source(spark, tmp_path, rows):
    schema = "seller_id string, revenue double"
    empty = load_optional(spark, str(tmp_path / "absent"), schema)
    assert empty.columns == ["seller_id", "revenue"] and empty.count() == 0
    assert load_optional(spark, None, schema).count() == 0
    write_small_csv(spark.createDataFrame([("s", 2.5)], schema), str(tmp_path / "there"))
    assert rows(load_optional(spark, str(tmp_path / "there"), schema)) == [("s", 2.5)]


@pytest.mark.parametrize("fmt, by_month", [("parquet", False), ("parquet", True), ("csv", False)])
def test_enriched_round_trip(spark, tmp_path, rows, fmt, by_month):
    orders = spark.createDataFrame(
        [("a", dt.datetime(2020, 1, 5, 3), 2020, 1, None, True, 'x "y", z'), ("b", None, 2020, 2, 1.5, False, None)],
        "order_id string, order_purchase_timestamp timestamp_ntz, purchase_year int, purchase_month int, "
        "delivery_delay_days double, is_late boolean, customer_state string",
    )
    path = str(tmp_path / "enriched")
    write_enriched_orders(orders, path, fmt, by_month)
    back = load_enriched_orders(spark, path, fmt).select(*orders.columns)
    assert rows(back) == rows(orders.fillna(0.0, ["delivery_delay_days"]))
    if by_month:
        assert (tmp_path / "enriched" / "purchase_year=2020" / "purchase_month=2").is_dir()


def test_top_tables_are_the_best_ten(spark, tmp_path):
    ranked = spark.range(15).select(
        F.concat(F.lit("k"), F.col("id")).alias("product_category_name_english"), F.col("id").cast("double").alias("revenue"))
    sellers = ranked.withColumnRenamed("product_category_name_english", "seller_id")
    paths = write_top_tables(ranked, sellers, str(tmp_path))
    back = scan_csv(spark, paths["sellers"])
    assert back.count() == 10 and {r["seller_id"] for r in back.collect()} == {f"k{i}" for i in range(5, 15)}
    assert len(list((tmp_path / "top_sellers").glob("part-*.csv"))) == 1


def test_workflow_from_csv(spark, csv_dir, tmp_path):
    paths = run_workflow(spark, load_tables(spark, str(csv_dir)), str(tmp_path / "out"))
    order = load_enriched_orders(spark, paths["enriched_orders"]).first()
    assert order["order_id"] == "o1" and order["n_items"] == 2
    assert order["total_order_value"] == pytest.approx(39.99)
    assert order["payment_type_mode"] == "voucher" and order["review_binary"] == 1
    assert order["customer_n_orders"] == 1 and order["distance_km_mean"] is None
    assert order["is_late"] is False and order["customer_state"] == "SP"


def test_workflow_equals_lazy_plan(spark, smallest_dir, tmp_path, rows):
    from checks.queries import enriched

    paths = run_workflow(spark, load_star_schema(spark, smallest_dir), str(tmp_path / "out"), partition_by_month=True)
    names = ["order_id", "customer_total_revenue", "distance_km_mean", "review_score_latest", "is_late"]
    exported = load_enriched_orders(spark, paths["enriched_orders"]).select(*names)
    lazy = enriched(spark, smallest_dir).select(*names)

    def shown(df):
        return rows(df.withColumns({n: F.round(n, 4) for n in names[1:3]}))

    assert shown(exported) == shown(lazy)
