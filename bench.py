"""Wall time of the headline queries; prints one JSON line.

Each query is planned and run to completion into a sink that discards rows, once to warm up the session and
then ``BENCH_RUNS`` times, of which the median counts. Dashboard queries read one export, which the warm-up writes.
``build`` is the part of it before the final write: building the plan and, for operators that count or stage first, those jobs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks import queries as q  # noqa: E402
from shopgrain.ml import build_delay_dataset, classification_report  # noqa: E402
from shopgrain.operators import (  # noqa: E402
    at_or_above_quantile, box_stats, correlation_matrix, exact_sample, histogram, missingness, stratified_split,
)
from shopgrain.plans import assembly, cube, dashboard, features, reports  # noqa: E402
from shopgrain.session import build_session, configure, materialize, name_local_folder  # noqa: E402


def order_distances(spark, sf):
    t = q.clean(spark, sf)
    return features.order_distance(t["orders"], t["customers"], t["sellers"], t["geolocation"], t["order_items"])


def product_review_stats(spark, sf):
    t = q.clean(spark, sf, "order_items", "reviews")
    return features.product_and_seller_review_stats(t["order_items"], t["reviews"])[0]


def top_categories(spark, sf):
    t = q.prepared(spark, sf)
    return reports.top_categories(t["order_items"], t["products"])


def sales_by_every_key(spark, sf):
    t = q.prepared(spark, sf)
    return reports.sales_by_every_key(t["order_items"], t["products"], assembly.attach_customers(t["orders"], t["customers"]))


def customer_value(spark, sf):
    return features.customer_value(q.order_values(spark, sf), unique_orders=True)


def stratified_review_split(spark, sf):
    reviews = q.clean(spark, sf, "reviews")["reviews"].select("order_id", "review_score")
    return stratified_split(reviews, ["order_id"], "review_score")


# The operators as a user calls them; the registered queries round their doubles on top, for comparison only.
HEADLINE = {
    "monthly_orders_revenue": lambda s, sf: reports.monthly_orders_and_revenue(q.order_values(s, sf)),
    "base_order_table": q.base_orders,
    "extended_items": lambda s, sf: assembly.build_base_orders(q.prepared(s, sf))[1],
    "enriched_orders": q.enriched,
    "order_distances": order_distances,
    "customer_value_table": customer_value,
    "product_review_stats": product_review_stats,
    "top_categories": top_categories,
    "sales_by_every_key": sales_by_every_key,
    "customer_value_as_of_order": lambda s, sf: features.customer_value_as_of_order(q.order_values(s, sf)),
    "top_sellers": lambda s, sf: reports.top_sellers(q.clean(s, sf, "order_items")["order_items"]),
    "business_kpis": lambda s, sf: reports.business_kpis(q.enriched(s, sf), unique_orders=True),
    "dashboard_kpis": lambda s, sf: dashboard.dashboard_kpis(q.chosen(s, sf), unique_orders=True),
    "cube_kpis": lambda s, sf: cube.kpis_of(q.chosen_cells(s, sf)),
    "dashboard_delay_by_state": lambda s, sf: dashboard.delay_by_state(q.chosen(s, sf)),
    "dashboard_top_customers": lambda s, sf: reports.top_customers_of_orders(q.chosen(s, sf)),
    "high_value_customers": lambda s, sf: at_or_above_quantile(
        materialize(customer_value(s, sf)), "customer_total_revenue", 0.95
    ),
    "base_missingness": lambda s, sf: missingness(q.base_orders(s, sf)),
    "correlation_of_order_facts": lambda s, sf: correlation_matrix(q.base_with_delivery(s, sf), q.CORRELATED),
    "delay_histogram": lambda s, sf: histogram(q.deliveries(s, sf), "delivery_delay_days", stage=materialize),
    "delay_box_by_score": lambda s, sf: box_stats(
        q.deliveries(s, sf), "delivery_delay_days", "review_score_latest", stage=materialize
    ),
    "price_freight_sample": lambda s, sf: exact_sample(
        q.clean(s, sf, "order_items")["order_items"], 20_000, ["order_id", "order_item_id", "product_id", "seller_id"],
        stage=materialize,
    ),
    "stratified_review_split": stratified_review_split,
    "delay_dataset": lambda s, sf: build_delay_dataset(q.enriched(s, sf), features.FEATURE_SETS["delay"].inputs),
    "score_classification_report": lambda s, sf: classification_report(q.class_rows(s, sf)),
}


def run(spark, name: str, sf_dir: str) -> tuple[float, float]:
    """Seconds in all, and of them before the final write."""
    start = time.perf_counter()
    df = HEADLINE[name](configure(spark), sf_dir)
    built = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start, built - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    name_local_folder(spark).sparkContext.setLogLevel("ERROR")
    times, builds = {}, {}
    for name in sys.argv[1:] or HEADLINE:
        run(spark, name, sf_dir)
        measured = sorted(run(spark, name, sf_dir) for _ in range(runs))
        times[name] = round(statistics.median(x for x, _ in measured), 3)
        builds[name] = round(statistics.median(x for _, x in measured), 3)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "build": builds,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
