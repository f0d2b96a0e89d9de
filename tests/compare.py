"""Run registered queries against their SQL twins: ``python tests/compare.py [sf_dir] [name ...]``."""

from __future__ import annotations

import datetime
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return connection


def plain(value):
    if value is None or isinstance(value, bool):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if hasattr(value, "as_integer_ratio"):
        return float(value)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cells = [tuple(plain(row[i]) for i in order) for row in rows]
    return [names[i] for i in order], sorted(cells, key=repr)


def spark_rows(df):
    return rows_of(df.columns, [tuple(row) for row in df.collect()])


def sql_rows(connection, text):
    result = connection.execute(text)
    return rows_of([column[0] for column in result.description], result.fetchall())


def difference(left, right) -> str | None:
    if left[0] != right[0]:
        return f"columns {set(left[0]) ^ set(right[0])}"
    if len(left[1]) != len(right[1]):
        return f"rows {len(left[1])} != {len(right[1])}"
    # Integers and floats of equal value are equal, so rows are compared after sorting as numbers.
    bad = [(a, b) for a, b in zip(left[1], right[1]) if a != b]
    return f"{len(bad)} rows differ, such as {bad[0]}" if bad else None


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    connection = connect(sf_dir)
    failed = 0
    for name in names:
        start = time.time()
        try:
            got = spark_rows(entry.queries()[name](spark, sf_dir))
            took = time.time() - start
            text = entry.oracle_sql().get(name)
            verdict = f"{len(got[1])} rows, no SQL" if text is None else difference(got, sql_rows(connection, text))
            if text is None:
                print(f"rows  {name} {took:.1f}s {verdict} {got[1][:2]}", flush=True)
                continue
        except Exception as error:  # report and go on with the next query
            verdict, took = f"{type(error).__name__}: {str(error)[:600]}", time.time() - start
        failed += verdict is not None
        print(f"{'FAIL' if verdict else 'ok  '}  {name} {took:.1f}s {verdict or len(got[1])}", flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main())
