"""Every registered query against its SQL twin in another engine."""

import pytest

from checks.oracle import oracle
from checks.queries import QUERIES
from compare import connect, difference, spark_rows, sql_rows

SQL = oracle()
WITHOUT_SQL = {
    "delay_model_metrics", "delay_model_error_by_state", "review_model_metrics", "satisfaction_model_metrics",
    "customer_value_model_metrics",
}


@pytest.fixture(scope="module")
def connection(smallest_dir):
    return connect(smallest_dir)


def test_only_models_lack_sql():
    assert set(QUERIES) - set(SQL) == WITHOUT_SQL
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", [name for name in QUERIES if name in SQL])
def test_query_equals_sql(name, spark, smallest_dir, connection):
    got = spark_rows(QUERIES[name](spark, smallest_dir))
    assert got[1], "a query without rows checks nothing"
    assert difference(got, sql_rows(connection, SQL[name])) is None


def test_dashboard_figures_are_not_all_zero(spark, smallest_dir):
    row = QUERIES["dashboard_kpis"](spark, smallest_dir).first()
    assert all(row)
