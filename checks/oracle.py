"""SQL twins of the registered queries, in the dialect of the checking engine.

Each text builds on the star-schema tables alone. ``STEPS`` are shared common table expressions; a query gets
those it names, with everything they build on.
"""

from __future__ import annotations

import re

from shopgrain.plans.features import FEATURE_SETS
from shopgrain.schemas import TABLE_COLUMNS
from shopgrain.sources.star_schema import BASE_TABLES, VIEWS

from .boosting_sql import boosted_steps, forest_steps
from .queries import BOOSTED, CHAIN, CORRELATED, DELAY_FOREST, END, INSIDE_DAYS, START, STATES

MODEL_SALT = "42"

STEPS: dict[str, str] = {
    f"v_{name}": text.format(**{base: base for base in BASE_TABLES}) for name, text in VIEWS.items()
}

STEPS |= {
    "c_orders": """
        select * exclude (rn) from (
          select *, row_number() over (partition by order_id order by customer_id nulls first, order_status nulls first,
            order_purchase_timestamp nulls first) as rn from v_orders)
        where rn = 1 and order_id is not null and customer_id is not null and order_purchase_timestamp is not null""",
    "c_items": """
        select * from v_order_items where order_id is not null and product_id is not null and seller_id is not null""",
    "c_customers": """
        select * exclude (rn) from (
          select *, row_number() over (partition by customer_id order by customer_unique_id) as rn from v_customers)
        where rn = 1""",
    "c_sellers": """
        select * exclude (rn) from (
          select *, row_number() over (partition by seller_id order by seller_zip_code_prefix) as rn from v_sellers)
        where rn = 1""",
    "c_reviews": """
        select review_id, order_id, review_score, cast(review_creation_date as timestamp) as review_creation_date,
          review_answer_timestamp
        from (
          select *, row_number() over (partition by order_id
            order by review_answer_timestamp desc nulls first, review_id desc) as rn from v_reviews)
        where rn = 1""",
    "c_products": """
        select p.product_id, p.product_category_name,
          coalesce(t.product_category_name_english, 'other') as product_category_name_english
        from v_products p left join v_category_translation t
          on p.product_category_name is not distinct from t.product_category_name""",
    "item_totals": """
        select order_id, count(order_item_id) as n_items, coalesce(sum(price), 0) as items_price_sum,
          coalesce(sum(freight_value), 0) as freight_value_sum
        from c_items group by order_id""",
    "payment_modes": """
        select order_id, payment_type as payment_type_mode from (
          select order_id, payment_type, row_number() over (partition by order_id
            order by count(*) desc, payment_type) as rn
          from v_payments where payment_type is not null group by order_id, payment_type)
        where rn = 1""",
    "payment_totals": """
        select t.order_id, payment_value_sum, payment_type_mode, payment_installments_max from (
          select order_id, coalesce(sum(payment_value), 0) as payment_value_sum,
            max(payment_installments) as payment_installments_max from v_payments group by order_id) t
        left join payment_modes m on t.order_id = m.order_id""",
    "review_summary": """
        select order_id, review_score as review_score_latest, review_creation_date as review_creation_date_max,
          review_answer_timestamp as review_answer_timestamp_max
        from c_reviews""",
    "order_facts": """
        select o.*, n_items, items_price_sum, freight_value_sum, payment_value_sum, payment_type_mode,
          payment_installments_max, review_score_latest, review_creation_date_max, review_answer_timestamp_max
        from c_orders o left join item_totals i on o.order_id = i.order_id
        left join payment_totals p on o.order_id = p.order_id
        left join review_summary r on o.order_id = r.order_id""",
    "base_orders": """
        select f.*, c.* exclude (customer_id) from order_facts f left join c_customers c on f.customer_id = c.customer_id""",
    "centroids": """
        select geolocation_zip_code_prefix as zip, avg(geolocation_lat) as lat, avg(geolocation_lng) as lng
        from v_geolocation where geolocation_zip_code_prefix is not null group by 1""",
    "customer_points": """
        select customer_id, lat as customer_lat, lng as customer_lng
        from c_customers left join centroids on customer_zip_code_prefix = zip""",
    "seller_points": """
        select seller_id, lat as seller_lat, lng as seller_lng
        from c_sellers left join centroids on seller_zip_code_prefix = zip""",
    "item_chords": """
        select i.order_id, power(sin(radians(seller_lat - customer_lat) / 2), 2)
          + cos(radians(customer_lat)) * cos(radians(seller_lat)) * power(sin(radians(seller_lng - customer_lng) / 2), 2)
          as a
        from c_items i left join c_orders o on i.order_id = o.order_id
        left join customer_points c on o.customer_id = c.customer_id
        left join seller_points s on i.seller_id = s.seller_id""",
    "distances": """
        select order_id, avg(2 * 6371.0 * asin(sqrt(case when a > 1 then 1 else a end))) as distance_km_mean
        from item_chords group by order_id""",
    "featured": """
        select f.* exclude (items_price_sum, freight_value_sum),
          coalesce(items_price_sum, 0) as items_price_sum, coalesce(freight_value_sum, 0) as freight_value_sum,
          year(order_purchase_timestamp) as purchase_year, month(order_purchase_timestamp) as purchase_month,
          day(order_purchase_timestamp) as purchase_day, isodow(order_purchase_timestamp) - 1 as purchase_weekday,
          hour(order_purchase_timestamp) as purchase_hour, isodow(order_purchase_timestamp) >= 6 as is_weekend,
          cast(date_trunc('month', order_purchase_timestamp) as timestamp) as order_purchase_date,
          date_diff('microsecond', order_purchase_timestamp, order_delivered_customer_date) / 86400e6
            as delivery_time_days,
          date_diff('microsecond', order_purchase_timestamp, order_estimated_delivery_date) / 86400e6
            as delivery_estimated_days,
          date_diff('microsecond', order_estimated_delivery_date, order_delivered_customer_date) / 86400e6
            as delivery_delay_days,
          coalesce(order_delivered_customer_date > order_estimated_delivery_date, false) as is_late,
          coalesce(items_price_sum, 0) + coalesce(freight_value_sum, 0) as total_order_value,
          items_price_sum / n_items as avg_item_price
        from order_facts f""",
    "interacting": """
        select f.*, case when items_price_sum = 0 then 0 else freight_value_sum / items_price_sum end
            as freight_to_price_ratio,
          coalesce(delivery_delay_days, 0) * total_order_value as delay_x_total_value
        from featured f""",
    "customer_value": """
        select customer_id, count(distinct order_id) as customer_n_orders,
          sum(total_order_value) as customer_total_revenue, avg(total_order_value) as customer_avg_order_value,
          max(order_purchase_timestamp) as customer_last_purchase
        from featured group by customer_id""",
    "customer_reviews": """
        select customer_id, avg(review_score_latest) as customer_review_score_mean,
          count(review_score_latest) as customer_review_count
        from featured group by customer_id""",
    "enriched": """
        select f.*, d.distance_km_mean, v.* exclude (customer_id), r.* exclude (customer_id), c.* exclude (customer_id)
        from interacting f left join distances d on f.order_id = d.order_id
        left join customer_value v on f.customer_id = v.customer_id
        left join customer_reviews r on f.customer_id = r.customer_id
        left join c_customers c on f.customer_id = c.customer_id""",
    "scored_items": """
        select i.product_id, i.seller_id, r.review_score
        from c_items i left join c_reviews r on i.order_id = r.order_id""",
    "category_sales": """
        select product_category_name_english, sum(price) as revenue, count(order_item_id) as n_items
        from c_items i join c_products p on i.product_id = p.product_id group by 1""",
    "seller_sales": """
        select seller_id, sum(price) as revenue, count(order_item_id) as n_items from c_items group by 1""",
    "regression_rows": """
        select order_id, customer_state, (order_id % 50) / 10e0 as actual, (order_id % 47) / 10e0 as predicted
        from c_orders o join c_customers c on o.customer_id = c.customer_id""",
    "chosen": f"""
        select * replace (coalesce(delivery_delay_days, 0) as delivery_delay_days) from enriched
        where customer_state in {STATES}
          and order_purchase_timestamp between timestamp '{START}' and timestamp '{END}'""",
    "chosen_kpis": """
        select coalesce(sum(total_order_value), 0) as total_revenue, count(distinct order_id)::double as n_orders,
          avg(delivery_delay_days) as avg_delay, avg(review_score_latest) as avg_review_score from chosen""",
    "chosen_customers": """
        select customer_id, max(customer_total_revenue) as revenue from chosen group by 1
        order by revenue desc, customer_id limit 15""",
    "first_categories": """
        select * from category_sales order by revenue desc, product_category_name_english limit 10""",
    "first_sellers": """
        select * from seller_sales order by revenue desc, seller_id limit 10""",
    "delay_rows": f"""
        select order_id, customer_state, items_price_sum, freight_value_sum, payment_value_sum, n_items,
          total_order_value, distance_km_mean, delivery_estimated_days, purchase_month, purchase_hour,
          freight_to_price_ratio, payment_type_mode, is_weekend, delivery_delay_days as label,
          case when substr(md5(order_id || ':{MODEL_SALT}'), 1, 8) < '33333333' then 'test' else 'train' end as split
        from enriched where delivery_delay_days is not null""",
    "class_rows": """
        select review_score as actual, cast((review_score + review_id % 3) % 5 + 1 as int) as predicted
        from v_reviews""",
    "classes": "select actual as class from class_rows union select predicted from class_rows",
    "class_counts": """
        select class, (select count(*) from class_rows where actual = class) as support,
          (select count(*) from class_rows where predicted = class) as said,
          (select count(*) from class_rows where predicted = class and actual = class) as hit
        from classes""",
    "class_report": """
        select class, case when said = 0 then 0 else hit / said end as precision,
          case when support = 0 then 0 else hit / support end as recall,
          case when said + support = 0 then 0 else 2e0 * hit / (said + support) end as f1, support
        from class_counts""",
    "thresholds": "select cast(10 + 5 * i as double) / 100 as threshold from range(17) t(i)",
    "curve": """
        select threshold, case when said = 0 then 0 else hit / said end as precision,
          case when pos = 0 then 0 else hit / pos end as recall,
          case when said + pos = 0 then 0 else 2e0 * hit / (said + pos) end as f1
        from (select threshold, count(*) filter (score >= threshold) as said,
            count(*) filter (score >= threshold and label = 1) as hit, count(*) filter (label = 1) as pos
          from v_scores cross join thresholds group by threshold)""",
    "best": """
        select threshold, f1, precision, recall from (select *, 0 as fallback from curve where f1 > 0
          union all select 0.5, 0, 0, 0, 1) order by fallback, f1 desc, threshold limit 1""",
    "auc": """
        select (sum(rank) filter (label = 1) - count(*) filter (label = 1) * (count(*) filter (label = 1) + 1) / 2)
          / (count(*) filter (label = 1) * count(*) filter (label = 0)) as roc_auc
        from (select label, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2 as rank
          from v_scores)""",
}


def with_steps(body: str) -> str:
    """``body`` preceded by the steps it needs, in definition order."""
    needed: set[str] = set()
    pending = [body]
    while pending:
        text = pending.pop()
        for name in STEPS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                pending.append(STEPS[name])
    steps = [f"{name} as ({STEPS[name].strip()})" for name in STEPS if name in needed]
    return ("with " + ",\n".join(steps) + "\n" if steps else "") + body.strip()


def _round(names: str, places: int = 6) -> str:
    return ", ".join(f"round({n}, {places}) as {n}" for n in names.split())


def _histogram(source: str, column: str, places: int) -> str:
    return f"""
        , {column}_bounds as (select min({column}) as lo, max({column}) as hi from {source})
        , {column}_bins as (
          select least(cast(floor(50e0 * ({column} - lo) / (hi - lo)) as int) + 1, 50) as bin, count(*) as n
          from {source}, {column}_bounds where {column} is not null group by 1)
        select cast(i as int) as bin, round(lo + (i - 1) * ((hi - lo) / 50), {places}) as bin_start,
          round(case when i = 50 then hi else lo + i * ((hi - lo) / 50) end, {places}) as bin_end,
          coalesce(n, 0) as n_rows
        from range(1, 51) r(i) cross join {column}_bounds left join {column}_bins on bin = i"""


def _histogram_query(source: str, column: str, places: int) -> str:
    # The bins extend the shared steps, so the query starts inside the with clause.
    text = with_steps(f"select 1 from {source}")
    return text[: text.rindex("select 1 from")] + _histogram(source, column, places)


def _missingness() -> str:
    columns = [
        *TABLE_COLUMNS["orders"], *[c for c in TABLE_COLUMNS["customers"] if c != "customer_id"], "n_items",
        "items_price_sum", "freight_value_sum", "payment_value_sum", "payment_type_mode", "payment_installments_max",
        "review_score_latest", "review_creation_date_max", "review_answer_timestamp_max",
    ]
    parts = " union all ".join(
        f"select '{c}' as column_name, count(*) - count({c}) as n_missing, count(*) as n from base_orders" for c in columns
    )
    return f"""select column_name, n_missing, round(n_missing * 100.0 / n, 2) as pct_missing from ({parts})
        order by pct_missing desc, column_name limit 20"""


def _correlation() -> str:
    return " union all ".join(
        f"select '{a}' as col_a, '{b}' as col_b, round(corr({a}, {b}), 6) as corr from featured"
        for a in CORRELATED for b in CORRELATED
    )


_BOX = """
    select review_score_latest, q1, median, q3, q1 - {reach} * (q3 - q1) as low, q3 + {reach} * (q3 - q1) as high
    from (select review_score_latest, quantile_cont(delivery_delay_days, 0.25) as q1,
        quantile_cont(delivery_delay_days, 0.5) as median, quantile_cont(delivery_delay_days, 0.75) as q3
      from featured where review_score_latest is not null and delivery_delay_days is not null group by 1)"""

_DELAY_NUMERIC = (
    "items_price_sum freight_value_sum payment_value_sum n_items total_order_value distance_km_mean "
    "delivery_estimated_days purchase_month purchase_hour freight_to_price_ratio"
)


def _constants(places: int | None) -> str:
    def shown(expr, name):
        return f"round({expr}, {places}) as {name}" if places is not None else f"{expr} as {name}"

    return " union all ".join(
        f"""select '{n}' as feature, {shown('max(med)', 'median')}, {shown(f'avg(coalesce({n}, med))', 'mean')},
          {shown(f'stddev_pop(coalesce({n}, med))', 'deviation')}
        from delay_rows, (select quantile_cont(cast({n} as double), 0.5) as med from delay_rows where split = 'train')
        where split = 'train'"""
        for n in _DELAY_NUMERIC.split()
    )


def _scaled() -> str:
    cells = ", ".join(
        f"""round((coalesce({n}, (select median from constants where feature = '{n}'))
          - (select mean from constants where feature = '{n}'))
          / (select deviation from constants where feature = '{n}'), 5) as {n}"""
        for n in _DELAY_NUMERIC.split()
    )
    text = with_steps("select 1 from delay_rows")
    return text[: text.rindex("select 1 from")] + f""", constants as ({_constants(None)})
        select order_id, split, {cells} from delay_rows"""


def _one_hot() -> str:
    """Counts per category position: payment types, then states, then the weekend flag, each in name order."""
    filled = ", ".join(
        f"""coalesce(cast({n} as varchar), (select cast({n} as varchar) from delay_rows where split = 'train'
          and {n} is not null group by {n} order by count(*) desc, cast({n} as varchar) limit 1)) as {n}"""
        for n in ("payment_type_mode", "customer_state", "is_weekend")
    )
    text = with_steps("select 1 from delay_rows")
    long = " union all ".join(
        f"select split, {i} as part, {n} as value from filled"
        for i, n in enumerate(("payment_type_mode", "customer_state", "is_weekend"))
    )
    return text[: text.rindex("select 1 from")] + f""", filled as (select split, {filled} from delay_rows),
        cells as ({long}),
        positions as (select part, value, row_number() over (order by part, value) - 1 as position
          from (select distinct part, value from cells where split = 'train'))
        select split, position, count(*) as n_rows from cells join positions using (part, value) group by 1, 2"""


_MONTHLY = """
    select order_purchase_date, count(order_id) as n_orders, round(sum(total_order_value), 4) as revenue
    from featured group by 1"""

_BODIES: dict[str, str] = {
    "csv_tables_profile": "@tables_profile",
    "csv_orders_scan": """
        select * replace (cast(order_id as varchar) as order_id, cast(customer_id as varchar) as customer_id)
        from v_orders""",
    "enriched_orders_reload": """
        select order_id, purchase_year, purchase_month, round(coalesce(delivery_delay_days, 0), 6) as delivery_delay_days,
          round(total_order_value, 6) as total_order_value, customer_state from enriched""",
    "enriched_orders_csv_reload": """
        select order_id, order_purchase_timestamp, round(coalesce(delivery_delay_days, 0), 6) as delivery_delay_days,
          is_late, n_items, review_score_latest, payment_type_mode from enriched""",
    "top_tables_export": """
        (select 'category' as ranking, product_category_name_english as name, round(revenue, 2) as revenue, n_items
          from category_sales order by category_sales.revenue desc, 2 limit 10)
        union all
        (select 'seller', cast(seller_id as varchar), round(revenue, 2), n_items
          from seller_sales order by seller_sales.revenue desc, seller_id limit 10)""",
    "workflow_export": _MONTHLY,
    "tables_profile": " union all ".join(
        f"select '{name}' as table_name, count(*) as n_rows, {len(columns) + (name == 'reviews')} as n_cols from v_{name}"
        for name, columns in TABLE_COLUMNS.items()
    ),
    "coerced_raw_orders": """
        select order_id, try_cast(purchase_text as timestamp) as purchase_ts, try_cast(price_text as double) as price
        from v_raw_orders""",
    "identifier_typing": """
        select cast(order_id as varchar) as order_id, cast(customer_id as varchar) as customer_id, order_status
        from v_orders""",
    "first_item_per_key": """
        select * exclude (rn) from (select *, row_number() over (partition by order_id, order_item_id
          order by product_id, seller_id, shipping_limit_date, price, freight_value) as rn from v_order_items)
        where rn = 1""",
    "cleaned_orders": "select * from c_orders",
    "cleaned_customers": "select * from c_customers",
    "latest_reviews": "select * from c_reviews",
    "complete_raw_orders": """
        select order_id, order_id as customer_id, try_cast(purchase_text as timestamp) as order_purchase_timestamp,
          try_cast(price_text as double) as price
        from v_raw_orders where try_cast(purchase_text as timestamp) is not null""",
    "translated_products": "select * from c_products",
    "order_item_totals": f"select order_id, n_items, {_round('items_price_sum freight_value_sum')} from item_totals",
    "order_payment_totals": f"""
        select order_id, {_round('payment_value_sum')}, payment_type_mode, payment_installments_max from payment_totals""",
    "order_review_summary": "select * from review_summary",
    "orders_with_customers": """
        select o.*, c.* exclude (customer_id) from c_orders o left join c_customers c on o.customer_id = c.customer_id""",
    "orders_with_facts_from_buckets": "@orders_with_facts",
    "orders_with_facts": """
        select * replace (round(items_price_sum, 6) as items_price_sum, round(freight_value_sum, 6) as freight_value_sum,
          round(payment_value_sum, 6) as payment_value_sum) from order_facts""",
    "base_order_table": """
        select * replace (round(items_price_sum, 6) as items_price_sum, round(freight_value_sum, 6) as freight_value_sum,
          round(payment_value_sum, 6) as payment_value_sum) from base_orders""",
    "extended_items": """
        select i.* replace (round(price, 6) as price, round(freight_value, 6) as freight_value),
          p.* exclude (product_id), s.* exclude (seller_id)
        from c_items i left join c_products p on i.product_id = p.product_id
        left join c_sellers s on i.seller_id = s.seller_id""",
    "items_with_sellers": """
        select i.* replace (round(price, 6) as price, round(freight_value, 6) as freight_value), s.* exclude (seller_id)
        from c_items i left join c_sellers s on i.seller_id = s.seller_id""",
    "time_features": """
        select order_id, purchase_year, purchase_month, purchase_day, purchase_weekday, purchase_hour, is_weekend,
          order_purchase_date from featured""",
    "delivery_features": f"""
        select order_id, {_round('delivery_time_days delivery_estimated_days delivery_delay_days')}, is_late
        from featured""",
    "monetary_features": f"""
        select order_id, n_items, {_round('items_price_sum freight_value_sum total_order_value avg_item_price')}
        from featured""",
    "interaction_features": f"""
        select order_id, {_round('freight_to_price_ratio')}, {_round('delay_x_total_value', 7)} from interacting""",
    "interaction_features_keep_missing": """
        select order_id, round(freight_to_price_ratio, 6) as freight_to_price_ratio,
          round(delivery_delay_days * total_order_value, 7) as delay_x_total_value
        from interacting""",
    "binary_review_target": """
        select order_id, review_score_latest, case when review_score_latest >= 4 then 1 else 0 end as review_binary
        from order_facts""",
    "customer_value_table": f"""
        select customer_id, customer_n_orders, {_round('customer_total_revenue')},
          {_round('customer_avg_order_value', 8)}, customer_last_purchase from customer_value""",
    "orders_with_customer_value": f"""
        select o.order_id, o.customer_id, customer_n_orders, {_round('customer_total_revenue')},
          {_round('customer_avg_order_value', 8)}, customer_last_purchase
        from c_orders o left join customer_value v on o.customer_id = v.customer_id""",
    "product_review_stats": """
        select product_id, round(avg(review_score), 6) as product_review_score_mean,
          count(review_score) as product_review_count from scored_items group by 1""",
    "seller_review_stats": """
        select seller_id, round(avg(review_score), 6) as seller_review_score_mean,
          count(review_score) as seller_review_count from scored_items group by 1""",
    "orders_with_customer_reviews": """
        select o.order_id, o.customer_id, round(customer_review_score_mean, 6) as customer_review_score_mean,
          customer_review_count
        from c_orders o left join customer_reviews r on o.customer_id = r.customer_id""",
    "zip_centroids": """
        select zip as geolocation_zip_code_prefix, round(lat, 9) as geo_lat, round(lng, 9) as geo_lng from centroids""",
    "customer_positions": f"select customer_id, {_round('customer_lat customer_lng', 9)} from customer_points",
    "seller_positions": f"select seller_id, {_round('seller_lat seller_lng', 9)} from seller_points",
    "order_distances": f"select order_id, {_round('distance_km_mean', 4)} from distances",
    "orders_with_distance": f"""
        select o.order_id, {_round('distance_km_mean', 4)}
        from c_orders o left join distances d on o.order_id = d.order_id""",
    "enriched_orders": """
        select * replace (
          round(items_price_sum, 6) as items_price_sum, round(freight_value_sum, 6) as freight_value_sum,
          round(payment_value_sum, 6) as payment_value_sum, round(total_order_value, 6) as total_order_value,
          round(avg_item_price, 6) as avg_item_price, round(delivery_time_days, 6) as delivery_time_days,
          round(delivery_estimated_days, 6) as delivery_estimated_days,
          round(delivery_delay_days, 6) as delivery_delay_days,
          round(freight_to_price_ratio, 6) as freight_to_price_ratio,
          round(delay_x_total_value, 7) as delay_x_total_value, round(distance_km_mean, 4) as distance_km_mean,
          round(customer_total_revenue, 6) as customer_total_revenue,
          round(customer_avg_order_value, 8) as customer_avg_order_value,
          round(customer_review_score_mean, 6) as customer_review_score_mean)
        from enriched""",
    "monthly_orders_revenue": _MONTHLY,
    "top_categories": """
        select product_category_name_english, round(revenue, 2) as revenue, n_items
        from category_sales order by category_sales.revenue desc, product_category_name_english limit 15""",
    "top_sellers": """
        select seller_id, round(revenue, 4) as revenue, n_items
        from seller_sales order by seller_sales.revenue desc, seller_id limit 15""",
    "top_five_of_rankings": """
        (select 'category' as ranking, product_category_name_english as name, round(revenue, 2) as revenue
          from category_sales order by category_sales.revenue desc, 2 limit 5)
        union all
        (select 'seller', cast(seller_id as varchar), round(revenue, 2)
          from seller_sales order by seller_sales.revenue desc, seller_id limit 5)""",
    "top_customers": """
        select customer_id, round(customer_total_revenue, 4) as customer_total_revenue, customer_n_orders
        from customer_value v order by v.customer_total_revenue desc, customer_id limit 5""",
    "labelled_top_customers": """
        select customer_id, round(customer_total_revenue, 4) as customer_total_revenue, customer_n_orders,
          'C' || lpad(cast(row_number() over (order by v.customer_total_revenue desc, customer_id) as varchar), 2, '0')
            as customer_label
        from customer_value v order by v.customer_total_revenue desc, customer_id limit 15""",
    "error_by_state": """
        select customer_state, round(avg(abs(actual - predicted)), 6) as mean_abs_error
        from regression_rows group by 1 order by 2 desc, 1 limit 10""",
    "business_kpis": """
        select round(sum(total_order_value), 2) as total_revenue, count(distinct order_id) as n_orders,
          round(avg(total_order_value), 6) as avg_order_value, round(avg(review_score_latest), 6) as avg_review_score,
          round(avg(cast(is_late as int)), 6) as late_delivery_rate from enriched""",
    "kpi_table": """
        select unnest(['Total revenue (BRL)', 'Number of orders', 'Average order value (BRL)',
            'Average review score (1–5)', 'Late delivery rate']) as "KPI",
          unnest([format('{:,.0f}', sum(total_order_value)), format('{:,}', count(distinct order_id)),
            format('{:,.2f}', avg(total_order_value)), format('{:.2f}', avg(review_score_latest)),
            format('{:.1f}%', avg(cast(is_late as int)) * 100)]) as "Value"
        from enriched""",
    "high_value_customers": f"""
        select customer_id, customer_n_orders, {_round('customer_total_revenue')},
          {_round('customer_avg_order_value', 8)}, customer_last_purchase from customer_value v
        where v.customer_total_revenue >= (select quantile_cont(customer_total_revenue, 0.95) from customer_value)""",
    "customers_with_zero_filled_value": """
        select c.customer_id, count(f.order_id) as customer_n_orders,
          round(coalesce(sum(total_order_value), 0), 6) as customer_total_revenue,
          round(avg(total_order_value), 8) as customer_avg_order_value,
          max(order_purchase_timestamp) as customer_last_purchase
        from c_customers c left join featured f on f.customer_id = c.customer_id
          and order_delivered_customer_date is not null
        group by 1""",
    "items_per_category_zero_filled": """
        select t.product_category_name_english, round(coalesce(revenue, 0), 2) as revenue, coalesce(n_items, 0) as n_items
        from (select distinct product_category_name_english from v_category_translation) t
        left join category_sales s on s.product_category_name_english = t.product_category_name_english""",
    "dashboard_filtered_orders": f"""
        select order_id, customer_state, order_purchase_timestamp, {_round('delivery_delay_days total_order_value')}
        from chosen""",
    "dashboard_kpis": """
        select round(coalesce(sum(total_order_value), 0), 2) as total_revenue, count(distinct order_id) as n_orders,
          round(avg(delivery_delay_days), 6) as avg_delay, round(avg(review_score_latest), 6) as avg_review_score
        from chosen""",
    "customer_value_as_of_order": """
        select o.order_id, any_value(o.customer_id) as customer_id, any_value(o.order_purchase_timestamp) as order_purchase_timestamp,
          count(p.order_id) as customer_prior_orders, round(coalesce(sum(p.total_order_value), 0), 6) as customer_prior_revenue,
          round(avg(p.total_order_value), 8) as customer_prior_avg_order_value
        from featured o left join featured p on p.customer_id = o.customer_id and p.order_purchase_timestamp < o.order_purchase_timestamp
        group by o.order_id""",
    "interaction_features_of_few_columns": """
        select order_id, round(items_price_sum, 6) as items_price_sum, 0.0::double as freight_to_price_ratio,
          0.0::double as delay_x_total_value, 2 as columns_left_out from featured""",
    "source_guards": """
        select 'empty table' as given, 'SourceEmptyError' as outcome union all select 'empty table allowed', '0'
        union all select 'table beside it', count(*)::varchar from v_orders union all select 'missing table', 'SourceMissingError'
        union all select 'missing export', 'SourceMissingError' union all select 'optional table', '0'""",
    "cube_kpis": "@dashboard_kpis",
    "cube_delay_by_state": "@dashboard_delay_by_state",
    "cube_review_scores": "@dashboard_review_scores",
    "cube_kpis_inside_days": f"""
        select round(coalesce(sum(total_order_value), 0), 2) as total_revenue, count(distinct order_id) as n_orders,
          round(avg(coalesce(delivery_delay_days, 0)), 6) as avg_delay, round(avg(review_score_latest), 6) as avg_review_score
        from enriched where customer_state in {STATES}
          and order_purchase_timestamp between timestamp '{INSIDE_DAYS[0]}' and timestamp '{INSIDE_DAYS[1]}'""",
    "incremental_export": f"""
        select order_id, customer_id, purchase_year, purchase_month, n_items, review_score_latest, customer_n_orders,
          customer_last_purchase, customer_review_count, customer_state,
          {_round('total_order_value delivery_delay_days customer_total_revenue customer_review_score_mean')},
          round(customer_avg_order_value, 8) as customer_avg_order_value
        from enriched""",
    "coercion_report": """
        select 'purchase_text' as "column", count(purchase_text) as n_given,
          count(purchase_text) - count(try_cast(purchase_text as timestamp)) as n_rejected from v_raw_orders
        union all select 'price_text', count(price_text), count(price_text) - count(try_cast(price_text as double)) from v_raw_orders""",
    "coercion_rejects": """
        select order_id, 'purchase_text' as "column", purchase_text as raw from v_raw_orders
          where purchase_text is not null and try_cast(purchase_text as timestamp) is null
        union all select order_id, 'price_text', price_text from v_raw_orders
          where price_text is not null and try_cast(price_text as double) is null""",
    "sales_by_every_key": """
        select grouping, "key", round(sum(price), 2) as revenue, count(order_item_id) as n_items from (
          select 'category' as grouping, product_category_name_english as "key", price, order_item_id
            from c_items join c_products using (product_id)
          union all select 'product', product_id::varchar, price, order_item_id from c_items
          union all select 'seller', seller_id::varchar, price, order_item_id from c_items
          union all select 'month', strftime(order_purchase_timestamp, '%Y-%m'), price, order_item_id from c_items join c_orders using (order_id)
          union all select 'state', customer_state, price, order_item_id from c_items join c_orders using (order_id)
            join c_customers using (customer_id))
        where "key" is not null group by 1, 2""",
    "dashboard_kpi_table": """
        select unnest(['Total revenue (BRL)', 'Number of orders', 'Average delay (days)', 'Average review score'])
            as "KPI",
          unnest([format('{:,.0f}', coalesce(sum(total_order_value), 0)), format('{:,}', count(distinct order_id)),
            coalesce(format('{:.2f}', avg(delivery_delay_days)), '-'),
            coalesce(format('{:.2f}', avg(review_score_latest)), '-')]) as "Value"
        from chosen""",
    "dashboard_delay_by_state": """
        select customer_state, round(avg(delivery_delay_days), 6) as avg_delay from chosen group by 1""",
    "dashboard_top_customers": """
        select customer_id, round(revenue, 4) as customer_total_revenue, n as customer_n_orders,
          'C' || lpad(cast(row_number() over (order by revenue desc, customer_id) as varchar), 2, '0') as customer_label
        from (select customer_id, max(customer_total_revenue) as revenue, max(customer_n_orders) as n
          from chosen group by 1)
        order by revenue desc, customer_id limit 15""",
    "dashboard_review_scores": """
        select review_score_latest, count(*) as n_orders from chosen where review_score_latest is not null group by 1""",
    "dashboard_delay_vs_review": f"""
        select order_id, {_round('delivery_delay_days')}, review_score_latest from chosen""",
    "dashboard_refresh": """
        select dataset, label, round(value::double, 2) as value from (
          select 'kpis' as dataset, unnest(['total_revenue', 'n_orders', 'avg_delay', 'avg_review_score']) as label,
            unnest([total_revenue, n_orders, avg_delay, avg_review_score]) as value from chosen_kpis
          union all select 'top_categories', product_category_name_english, n_items from first_categories
          union all select 'top_sellers', seller_id::varchar, n_items from first_sellers
          union all select 'delay_by_state', customer_state, avg(delivery_delay_days) from chosen group by 2
          union all select 'top_customers', customer_id::varchar, revenue from chosen_customers
          union all select 'review_scores', review_score_latest::varchar, count(*) from chosen
            where review_score_latest is not null group by 2
          union all select 'delay_vs_review', order_id::varchar, delivery_delay_days from chosen)""",
    "price_quantiles_by_product": """
        select product_id, round(quantile_cont(price, 0.25), 6) as q1, round(quantile_cont(price, 0.5), 6) as median,
          round(quantile_cont(price, 0.75), 6) as q3 from c_items group by 1""",
    "state_options": """
        select distinct customer_state from c_orders o join c_customers c on o.customer_id = c.customer_id
        where customer_state is not null""",
    "date_bounds": """
        select min(order_purchase_timestamp) as date_min, max(order_purchase_timestamp) as date_max from c_orders""",
    "base_missingness": _missingness(),
    "customers_by_state": "select customer_state, count(*) as n_customers from c_customers group by 1",
    "payments_by_type": """
        select payment_type, count(*) as n_payments from v_payments where payment_type is not null group by 1""",
    "review_score_counts": """
        select review_score_latest, count(*) as n_orders from order_facts
        where review_score_latest is not null group by 1""",
    "delay_box_by_score": f"""
        select f.review_score_latest, count(*) as n_rows, round(q1, 6) as q1, round(median, 6) as median,
          round(q3, 6) as q3,
          round(min(delivery_delay_days) filter (delivery_delay_days between low and high), 6) as whisker_low,
          round(max(delivery_delay_days) filter (delivery_delay_days between low and high), 6) as whisker_high,
          count(*) filter (delivery_delay_days < low or delivery_delay_days > high) as n_outliers
        from featured f join ({_BOX.format(reach=1.5)}) b on f.review_score_latest = b.review_score_latest
        where delivery_delay_days is not null group by f.review_score_latest, q1, median, q3""",
    "delay_outliers_by_score": f"""
        select f.review_score_latest, round(delivery_delay_days, 6) as delivery_delay_days
        from featured f join ({_BOX.format(reach=0.5)}) b on f.review_score_latest = b.review_score_latest
        where delivery_delay_days < low or delivery_delay_days > high""",
    "correlation_of_order_facts": _correlation(),
    "price_freight_sample": f"""
        select order_id, order_item_id, product_id, seller_id, {_round('price freight_value')}
        from c_items i order by
          md5(concat_ws(':', order_id, order_item_id, product_id, seller_id, '0')), order_id, order_item_id,
          product_id, seller_id, shipping_limit_date, i.price, i.freight_value limit 20000""",
    "pair_plot_sample": f"""
        select order_id, {_round(' '.join(CORRELATED))} from featured where
        {' and '.join(f'{c} is not null' for c in CORRELATED)} order by md5(order_id || ':0'), order_id limit 2000""",
    "holdout_split": """
        select order_id, case when substr(md5(order_id || ':42'), 1, 8) < '33333333' then 'test' else 'train' end as split
        from c_orders""",
    "stratified_review_split": """
        select order_id, review_score, case when row_number() over (partition by review_score
            order by substr(md5(order_id || ':42'), 1, 13)) <= ceil(count(*) over (partition by review_score) * 0.2e0)
          then 'test' else 'train' end as split
        from c_reviews""",
    "delay_dataset": """
        select * replace (
          round(items_price_sum, 6) as items_price_sum, round(freight_value_sum, 6) as freight_value_sum,
          round(payment_value_sum, 6) as payment_value_sum, round(total_order_value, 6) as total_order_value,
          round(distance_km_mean, 4) as distance_km_mean, round(delivery_estimated_days, 6) as delivery_estimated_days,
          round(freight_to_price_ratio, 6) as freight_to_price_ratio, round(label, 6) as label)
        from delay_rows""",
    "review_dataset": f"""
        select order_id, {_round('total_order_value')}, n_items, {_round('delivery_delay_days')},
          {_round('distance_km_mean', 4)}, {_round('customer_total_revenue')}, customer_n_orders,
          {_round('freight_to_price_ratio')}, {_round('delay_x_total_value', 7)}, payment_type_mode, customer_state,
          review_score_latest as label,
          case when row_number() over (partition by review_score_latest
            order by substr(md5(order_id || ':42'), 1, 13)) <= ceil(count(*) over (partition by review_score_latest) * 0.2e0)
          then 'test' else 'train' end as split
        from enriched where review_score_latest is not null""",
    "numeric_preprocessing_constants": _constants(4),
    "categorical_preprocessing_constants": "select " + ", ".join(
        f"""(select cast({n} as varchar) from delay_rows where split = 'train' and {n} is not null
          group by {n} order by count(*) desc, cast({n} as varchar) limit 1) as {n}"""
        for n in ("payment_type_mode", "customer_state", "is_weekend")
    ),
    "review_class_weights": """
        select review_score, count(*) as n_rows,
          round((select count(*) / count(distinct review_score) from c_reviews) / count(*), 6) as class_weight
        from c_reviews group by 1""",
    "regression_quality": """
        select round(sqrt(avg(power(actual - predicted, 2))), 6) as rmse, round(avg(abs(actual - predicted)), 6) as mae,
          round(1 - sum(power(actual - predicted, 2)) / (count(*) * var_pop(actual)), 6) as r2
        from regression_rows""",
    "actual_vs_predicted": """
        select *, round(abs(actual - predicted), 6) as abs_error from regression_rows""",
    "score_classification_report": f"select class, {_round('precision recall f1')}, support from class_report",
    "score_report_summary": """
        select round(sum(recall * support) / sum(support), 6) as accuracy, round(avg(precision), 6) as precision_macro,
          round(avg(recall), 6) as recall_macro, round(avg(f1), 6) as f1_macro,
          round(sum(precision * support) / sum(support), 6) as precision_weighted,
          round(sum(recall * support) / sum(support), 6) as recall_weighted,
          round(sum(f1 * support) / sum(support), 6) as f1_weighted, cast(sum(support) as bigint) as support
        from class_report""",
    "score_confusion_matrix": """
        select a.class as actual, p.class as predicted, count(r.actual) as n_rows
        from classes a cross join classes p left join class_rows r on r.actual = a.class and r.predicted = p.class
        group by 1, 2""",
    "quality_roc_auc": "select round(roc_auc, 6) as roc_auc from auc",
    "quality_threshold_curve": f"select threshold, {_round('precision recall f1')} from curve",
    "quality_best_threshold": f"select threshold, {_round('f1 precision recall')} from best",
    "quality_binary_summary": """
        select round(c.accuracy, 6) as accuracy, round(roc_auc, 6) as roc_auc, round((f1_0 + f1_1) / 2, 6) as f1_macro,
          round((f1_0 * n0 + f1_1 * n1) / (n0 + n1), 6) as f1_weighted, round(f1_1, 6) as f1_positive,
          best.threshold as best_threshold, round(best.f1, 6) as f1_at_best_threshold,
          round(best.precision, 6) as precision_at_best_threshold, round(best.recall, 6) as recall_at_best_threshold
        from auc, best, (select (tp + tn) / (n0 + n1) as accuracy, n0, n1,
            2e0 * tp / (2 * tp + fp + fn) as f1_1, 2e0 * tn / (2 * tn + fp + fn) as f1_0
          from (select count(*) filter (label = 1 and score >= 0.5) as tp, count(*) filter (label = 0 and score < 0.5) as tn,
              count(*) filter (label = 0 and score >= 0.5) as fp, count(*) filter (label = 1 and score < 0.5) as fn,
              count(*) filter (label = 1) as n1, count(*) filter (label = 0) as n0 from v_scores)) c""",
}


def _boosted(name: str, source: str, shown: str, weight: str = "1.0::double") -> str:
    """A chain of boosting steps over the rows of another query's text."""
    task = BOOSTED[name]
    steps = boosted_steps("given", task.numeric, task.categorical, task.objective, task.settings, task.classes, weight)
    chain = ", ".join(f"{step} as materialized ({text})" for step, text in {"given": source, **steps}.items())
    return f"with {chain} select {shown} from scored join known using (order_id) where scored.split = 'test'"


_BALANCED = """(select count(*) / count(distinct label) from known where split = 'train')
    / greatest(count(*) filter (split = 'train') over (partition by label), 1)"""


def _forest(source: str, steps: dict[str, str], shown: str) -> str:
    chain = ", ".join(f"{step} as materialized ({text})" for step, text in {"given": source, **steps}.items())
    return f"with {chain} select {shown} from averaged join known using (order_id) where averaged.split = 'test'"


def _forest_texts() -> dict[str, str]:
    chain = with_steps(f"""
        select order_id, (order_id % 36)::double as place, pow(2.5, order_id % 36) / 1048576 as label,
          case when substr(md5(order_id || ':{MODEL_SALT}'), 1, 8) < '33333333' then 'test' else 'train' end as split
        from c_orders""")
    delay, review = with_steps(_BODIES["delay_dataset"]), FEATURE_SETS["delay"]
    depth = "(select max(d) + 1 from ({})) as depth".format(
        " union all ".join(f"select {k} as d from best_{k} where f is not null" for k in range(45)))
    return {
        "deep_forest_scores": _forest(
            chain, forest_steps("given", ["place"], [], CHAIN, 45), f"order_id, round(prediction, 3) as prediction, {depth}"),
        "delay_forest_scores": _forest(
            delay, forest_steps("given", review.numeric, review.categorical, DELAY_FOREST, DELAY_FOREST.max_depth),
            "order_id, label, round(prediction, 6) as prediction"),
    }


def _boosted_texts() -> dict[str, str]:
    review, delay = with_steps(_BODIES["review_dataset"]), with_steps(_BODIES["delay_dataset"])
    satisfaction = with_steps("""
        select * exclude (score), case when score >= 4 then 1 else 0 end as label from (
          select * exclude (label), label as score from ({review}))""".format(review=_BODIES["review_dataset"]))
    return {
        "review_softmax_scores": _boosted(
            "review_softmax_scores", review,
            "order_id, label, list_position(p, list_max(p)) as prediction, " + ", ".join(f"round(p[{k}], 6) as p{k}" for k in range(1, 6)),
            _BALANCED,
        ),
        "satisfaction_boosted_scores": _boosted(
            "satisfaction_boosted_scores", satisfaction, "order_id, label, (p[2] > p[1])::int as prediction, round(p[2], 6) as score", _BALANCED
        ),
        "delay_boosted_scores": _boosted("delay_boosted_scores", delay, "order_id, label, round(m[1], 6) as prediction"),
    }


def oracle() -> dict[str, str]:
    texts = {name: with_steps(body) for name, body in _BODIES.items() if not body.startswith("@")}
    texts |= {name: texts[body[1:]] for name, body in _BODIES.items() if body.startswith("@")}
    texts |= {
        "item_sum_histogram": _histogram_query("featured", "items_price_sum", 4),
        "freight_sum_histogram": _histogram_query("featured", "freight_value_sum", 4),
        "delay_histogram": _histogram_query("featured", "delivery_delay_days", 6),
        "scaled_delay_features": _scaled(),
        "one_hot_delay_features": _one_hot(),
        "one_hot_delay_positions": _one_hot(),
    }
    return texts | _boosted_texts() | _forest_texts()
