"""The nine input tables as views over an order/line-item star schema in Parquet.

The text of each view runs unchanged in any ANSI SQL engine, so a second engine can check the results.
Curly names are the base tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Declared, so that opening a table starts no schema-inference job.
BASE_SCHEMAS = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "labels": "doc_id bigint, quality int, toxic int",
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
        "l_shipdate timestamp_ntz"
    ),
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
}
BASE_TABLES = tuple(BASE_SCHEMAS)

VIEWS: dict[str, str] = {
    "orders": """
        select o_orderkey as order_id, o_custkey as customer_id, o_orderstatus as order_status,
          o_orderdate + interval '1' hour * (o_orderkey % 24) as order_purchase_timestamp,
          o_orderdate + interval '1' hour * (24 + o_orderkey % 24) as order_approved_at,
          case when o_orderkey % 11 = 0 then null
            else o_orderdate + interval '1' hour * (48 + o_orderkey % 48) end as order_delivered_carrier_date,
          case when o_orderkey % 11 = 0 then null
            else o_orderdate + interval '1' hour * (96 + (o_orderkey * 7) % 960) end as order_delivered_customer_date,
          o_orderdate + interval '1' day * (15 + o_orderkey % 10) as order_estimated_delivery_date
        from {orders}""",
    "order_items": """
        select l_orderkey as order_id, l_linenumber as order_item_id, l_partkey as product_id, l_suppkey as seller_id,
          l_shipdate as shipping_limit_date, l_extendedprice as price, l_extendedprice * l_tax as freight_value
        from {lineitem}""",
    "payments": """
        select l_orderkey as order_id, l_linenumber as payment_installments,
          case when l_partkey % 29 = 0 then null else l_returnflag end as payment_type,
          l_extendedprice * (1 - l_discount) as payment_value
        from {lineitem}""",
    "reviews": """
        select event_id as review_id, cast(floor(event_id / 2) as bigint) as order_id,
          cast(regexp_extract(props, '([0-9]+)', 1) as int) % 5 + 1 as review_score,
          cast(ts as date) as review_creation_date,
          case when event_id % 13 = 0 then null else ts end as review_answer_timestamp
        from {events}""",
    "products": """
        select p_partkey as product_id,
          case when p_partkey % 17 = 0 then null else p_type end as product_category_name
        from {part}""",
    "category_translation": """
        select * from (values ('ECONOMY', 'economy'), ('LARGE', 'large'), ('MEDIUM', 'medium'),
          ('SMALL', 'small'), ('STANDARD', 'standard'))
        as t(product_category_name, product_category_name_english)""",
    "customers": """
        select c_custkey as customer_id, c_name as customer_unique_id, c_nationkey as customer_zip_code_prefix,
          n_name as customer_state
        from {customer} join {nation} on c_nationkey = n_nationkey""",
    "sellers": """
        select s_suppkey as seller_id, s_nationkey as seller_zip_code_prefix, s_name as seller_city,
          n_name as seller_state
        from {supplier} join {nation} on s_nationkey = n_nationkey""",
    "geolocation": """
        select c_nationkey as geolocation_zip_code_prefix, (c_nationkey - 33) + (c_custkey % 10) / 1e2 as geolocation_lat,
          (c_nationkey * 2 - 70) + (c_custkey % 7) / 1e2 as geolocation_lng
        from {customer} where c_nationkey <> 24""",
    # Text with unreadable dates and amounts.
    "raw_orders": """
        select o_orderkey as order_id,
          case when o_orderkey % 13 = 0 then 'bad' else cast(o_orderdate as string) end as purchase_text,
          case when o_orderkey % 17 = 0 then 'n/a' else cast(o_totalprice as string) end as price_text
        from {orders}""",
    # Predictions of known form for the metrics.
    "scores": """
        select doc_id as id, quality as label, (quality * 30 + (doc_id * 37) % 71) / 101e0 as score
        from {labels}""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One view over the Parquet tables in ``sf_dir``."""
    text = VIEWS[name]
    bases = {
        base: spark.read.schema(schema).parquet(f"{sf_dir}/{base}.parquet")
        for base, schema in BASE_SCHEMAS.items()
        if "{" + base + "}" in text
    }
    return spark.sql(text, **bases)


def load_star_schema(spark: SparkSession, sf_dir: str, names: tuple[str, ...] | None = None) -> dict[str, DataFrame]:
    """The nine input tables (or those in ``names``) by logical name."""
    from ..schemas import TABLE_NAMES

    return {name: view(spark, sf_dir, name) for name in (names or TABLE_NAMES)}
