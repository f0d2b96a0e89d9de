"""Names, keys and column types of the nine input tables."""

from __future__ import annotations

# Columns the analyses name. Further columns of a source are carried through untouched.
TABLE_COLUMNS: dict[str, dict[str, str]] = {
    "customers": {
        "customer_id": "string",
        "customer_unique_id": "string",
        "customer_zip_code_prefix": "int",
        "customer_state": "string",
    },
    "geolocation": {
        "geolocation_zip_code_prefix": "int",
        "geolocation_lat": "double",
        "geolocation_lng": "double",
    },
    "orders": {
        "order_id": "string",
        "customer_id": "string",
        "order_status": "string",
        "order_purchase_timestamp": "timestamp_ntz",
        "order_approved_at": "timestamp_ntz",
        "order_delivered_carrier_date": "timestamp_ntz",
        "order_delivered_customer_date": "timestamp_ntz",
        "order_estimated_delivery_date": "timestamp_ntz",
    },
    "order_items": {
        "order_id": "string",
        "order_item_id": "int",
        "product_id": "string",
        "seller_id": "string",
        "shipping_limit_date": "timestamp_ntz",
        "price": "double",
        "freight_value": "double",
    },
    "payments": {
        "order_id": "string",
        "payment_type": "string",
        "payment_installments": "int",
        "payment_value": "double",
    },
    "reviews": {
        "order_id": "string",
        "review_score": "int",
        "review_creation_date": "timestamp_ntz",
        "review_answer_timestamp": "timestamp_ntz",
    },
    "products": {"product_id": "string", "product_category_name": "string"},
    "sellers": {
        "seller_id": "string",
        "seller_zip_code_prefix": "int",
        "seller_city": "string",
        "seller_state": "string",
    },
    "category_translation": {
        "product_category_name": "string",
        "product_category_name_english": "string",
    },
}

TABLE_NAMES = tuple(TABLE_COLUMNS)

# Free text with quoted line breaks: such a CSV file cannot be split over tasks.
MULTILINE_TABLES = frozenset({"reviews"})

PRIMARY_KEYS = {
    "customers": ["customer_id"],
    "orders": ["order_id"],
    "products": ["product_id"],
    "sellers": ["seller_id"],
}

REQUIRED_COLUMNS = {
    "orders": ["order_id", "customer_id", "order_purchase_timestamp"],
    "order_items": ["order_id", "product_id", "seller_id"],
}

IDENTIFIER_COLUMNS = {
    "customers": ["customer_id", "customer_unique_id", "customer_state"],
    "orders": ["order_id", "customer_id", "order_status"],
    "order_items": ["order_id", "product_id", "seller_id"],
    "products": ["product_id", "product_category_name"],
    "sellers": ["seller_id", "seller_state"],
}


def columns_of_type(table: str, dtype: str) -> list[str]:
    return [name for name, declared in TABLE_COLUMNS[table].items() if declared == dtype]


# Order-level columns added on the way from cleaned tables to enriched orders, with the type each has
# when the enriched table is read back from text.
ENRICHED_COLUMNS: dict[str, str] = {
    **TABLE_COLUMNS["orders"],
    **{name: dtype for name, dtype in TABLE_COLUMNS["customers"].items() if name != "customer_id"},
    "n_items": "bigint",
    "items_price_sum": "double",
    "freight_value_sum": "double",
    "payment_value_sum": "double",
    "payment_type_mode": "string",
    "payment_installments_max": "int",
    "review_score_latest": "int",
    "review_creation_date_max": "timestamp_ntz",
    "review_answer_timestamp_max": "timestamp_ntz",
    "purchase_year": "int",
    "purchase_month": "int",
    "purchase_day": "int",
    "purchase_weekday": "int",
    "purchase_hour": "int",
    "is_weekend": "boolean",
    "order_purchase_date": "timestamp_ntz",
    "delivery_time_days": "double",
    "delivery_estimated_days": "double",
    "delivery_delay_days": "double",
    "is_late": "boolean",
    "total_order_value": "double",
    "avg_item_price": "double",
    "customer_n_orders": "bigint",
    "customer_total_revenue": "double",
    "customer_avg_order_value": "double",
    "customer_last_purchase": "timestamp_ntz",
    "customer_review_score_mean": "double",
    "customer_review_count": "bigint",
    "distance_km_mean": "double",
    "freight_to_price_ratio": "double",
    "delay_x_total_value": "double",
    "review_binary": "int",
}
