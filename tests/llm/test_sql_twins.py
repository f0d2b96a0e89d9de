"""Registered queries of the training-data operators against their SQL twins."""

import pytest

from compare import connect, difference, spark_rows, sql_rows
from shopgrain.llm.oracle import oracle
from shopgrain.llm.queries import QUERIES

SQL = oracle()


def test_every_operator_is_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, spark, smallest_dir):
    got = spark_rows(QUERIES[name](spark, smallest_dir))
    assert got[1]
    assert difference(got, sql_rows(connect(smallest_dir), SQL[name])) is None
