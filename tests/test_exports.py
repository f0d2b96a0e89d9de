"""Cells, instalments and counted coercions against the plain operators, and what they read and rewrite."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from checks import queries as registered
from checks.oracle import oracle
from checks.queries import QUERIES
from compare import connect, difference, spark_rows, sql_rows
from shopgrain.plans import cube, dashboard, features, incremental
from shopgrain.session import materialize, stage_path
from shopgrain.sources import coerce_counted, load_enriched_orders

DASHBOARD = [name for name in QUERIES if name.startswith(("dashboard_", "cube_"))]


@pytest.fixture(scope="module")
def larger_dir():
    folder = Path("/root/testdata/sf0.01")
    if not folder.exists():
        pytest.skip("test data not present")
    return str(folder)


@pytest.mark.parametrize("name", DASHBOARD)
def test_dashboard_equals_sql_on_more_rows(name, spark, larger_dir):
    assert difference(spark_rows(QUERIES[name](spark, larger_dir)), sql_rows(connect(larger_dir), oracle()[name])) is None


BOUNDS = [
    (None, None), ("1994-01-01", "1995-01-01"), ("1994-01-01 00:00:01", "1994-01-01 23:59:59"), ("1996-05-05 12:00:00", "1996-05-06 01:00:00"),
    ("1993-03-03 03:03:03", "1997-07-07 07:07:07"), ("1996-01-01", "1996-01-01"), ("1998-01-01", "1997-01-01"),
]


@pytest.mark.parametrize("start, end", BOUNDS)
@pytest.mark.parametrize("states", [(), ("NATION_1", "NATION_3", "NATION_9")])
def test_cells_answer_like_rows(spark, smallest_dir, start, end, states):
    orders = load_enriched_orders(spark, registered.exported(spark, smallest_dir)["enriched_orders"])
    cells = spark.read.parquet(registered.exported(spark, smallest_dir)["cells"])
    got, want = cube.choose_cells(cells, orders, states, start, end), dashboard.filter_orders(orders, states, start, end)
    pairs = [
        (cube.kpis_of(got), dashboard.dashboard_kpis(want)), (cube.delay_by_state_of(got), dashboard.delay_by_state(want)),
        (cube.review_scores_of(got), dashboard.review_score_counts(want)),
    ]
    for left, right in pairs:
        a, b = ([tuple(r) for r in x.select(*sorted(x.columns)).orderBy(*sorted(x.columns)).collect()] for x in (left, right))
        assert len(a) == len(b)
        for x, y in zip(a, b):
            assert [v if not isinstance(v, float) else pytest.approx(v) for v in x] == list(y)


def test_whole_days_do_not_read_the_wide_table(spark, smallest_dir, capsys):
    paths = registered.exported(spark, smallest_dir)
    orders, cells = load_enriched_orders(spark, paths["enriched_orders"]), spark.read.parquet(paths["cells"])
    cube.choose_cells(cells, orders, (), "1994-01-01", "1996-06-01 10:00:00").explain("formatted")
    pushed = [x for x in re.findall(r"PushedFilters: .*", capsys.readouterr().out) if "order_purchase_timestamp" in x]
    (wide,) = pushed
    assert "GreaterThanOrEqual(order_purchase_timestamp,1996-06-01T00:00)" in wide and "1996-06-02T00:00" in wide


def test_rankings_scan_the_items_once(spark, smallest_dir):
    plan = QUERIES["sales_by_every_key"](spark, smallest_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1 and "Expand" in plan and "partial_sum" in plan


def files(base):
    return {p: p.stat().st_mtime_ns for p in Path(base).rglob("*.parquet")}


def test_instalments(spark, smallest_dir):
    tables = registered.prepared(spark, smallest_dir)
    base = stage_path(spark, "test-instalments").removeprefix("file:")
    orders = materialize(tables["orders"])
    year = F.year("order_purchase_timestamp")

    def add(rows):
        return incremental.export_instalment(spark, {**tables, "orders": rows}, base)

    def content():
        return spark_rows(incremental.load_export(spark, base, tables["customers"]))

    assert {y for y, _ in add(orders.where(year < 1995))} <= set(range(1990, 1995))
    before = files(base)
    months = add(orders.where(year >= 1995))
    assert all(y >= 1995 for y, _ in months) and before.items() <= files(base).items()  # untouched months keep their files
    whole = content()
    assert len(whole[1]) == orders.count()
    add(orders.where(year == 1996))
    assert content() == whole  # a repeated instalment changes nothing
    # An order that moves to another month takes its customer's figures along; an emptied month disappears.
    alone = orders.orderBy("order_purchase_timestamp").limit(1)
    moved = alone.withColumn("order_purchase_timestamp", F.expr("TIMESTAMP_NTZ'1989-06-05 00:00:00'"))
    add(moved)
    again = incremental.load_export(spark, base, tables["customers"])
    assert again.count() == len(whole[1]) and again.where("purchase_year = 1989").count() == 1
    add(moved.withColumn("order_purchase_timestamp", F.expr("TIMESTAMP_NTZ'1988-06-05 00:00:00'")))
    assert not list(Path(base).glob("*/purchase_year=1989/purchase_month=6/*.parquet"))
    assert spark.read.parquet(f"{base}/customer_months").agg(F.sum("n_orders")).first()[0] == len(whole[1])
    assert add(orders.limit(0)) == []


def test_coercions_are_counted_in_one_pass(spark):
    text = spark.createDataFrame(
        [(1, "2020-01-01", "5"), (2, "never", "x"), (3, None, None), (4, "2020-13-01", "1e3"), (4, "2020-13-01", "nan")], "id int, at string, price string"
    )
    calls = []
    found = coerce_counted(text, {"at": "timestamp_ntz", "price": "double", "absent": "int"}, ["id"], lambda df: calls.append(1) or materialize(df))
    assert [tuple(r) for r in found.report.collect()] == [("at", 4, 3), ("price", 4, 2)] and calls == [1]
    rejected = sorted(tuple(r) for r in found.rejects.collect())
    assert rejected == [(2, "at", "never"), (2, "price", "x"), (4, "at", "2020-13-01"), (4, "at", "2020-13-01"), (4, "price", "nan")]
    assert dict(found.rows.dtypes) == {"id": "int", "at": "timestamp_ntz", "price": "double"} and found.rows.count() == 5
    empty = coerce_counted(text.limit(0), {"price": "double"}, ["id"], materialize)
    assert [tuple(r) for r in empty.report.collect()] == [("price", 0, 0)] and empty.rejects.count() == 0


def test_a_customer_of_a_third_of_all_orders_is_split(spark):
    n = F.col("id")
    orders = spark.range(3000).select(
        n.alias("order_id"), F.when(n % 3 == 0, 1).otherwise(n).alias("customer_id"),
        F.timestamp_seconds(n * 7000).cast("timestamp_ntz").alias("order_purchase_timestamp"), (n * 1.0).alias("total_order_value"),
    )
    valued = features.customer_value_as_of_order(orders)
    last = valued.where("order_id = 2997").first()
    # The customer's own orders and order number 1; orders at the same moment would not count.
    assert (last.customer_prior_orders, last.customer_prior_revenue) == (1000, sum(range(0, 2997, 3)) + 1.0)
    first = valued.where("order_id = 0").first()
    assert (first.customer_prior_orders, first.customer_prior_revenue, first.customer_prior_avg_order_value) == (0, 0.0, None)
    windows = re.findall(r"Window .*", valued._jdf.queryExecution().executedPlan().toString())
    assert all("customer_id" in w for w in windows) and any("day" in w and "RangeFrame" in w for w in windows)


def test_buckets_join_without_exchange(spark, smallest_dir):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = registered.bucketed_facts(spark, smallest_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Exchange" not in plan and "SortMergeJoin" in plan and "Bucketed: true" in plan
