"""Tables kept in buckets by their join key, so that repeated runs join them without an exchange.

Orders, items, payments and reviews are cut by the same hash of ``order_id`` into the same number of buckets, and sorted by
it. Deduplication, totals per order and the joins of the order facts then work bucket by bucket. The order key is spread
evenly; a customer may hold a third of all orders, so what is joined by customer keeps the spread joins.

The bucket layout is known to the session's catalog, which a new session fills again with ``open_bucketed``; the files are
plain Parquet and can be read as such.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

ORDER_KEYED = ("orders", "order_items", "payments", "reviews")


def write_bucketed(tables: Mapping[str, DataFrame], base: str, buckets: int) -> dict[str, DataFrame]:
    """Write the tables keyed by order under ``base`` and read them back; other tables stay as they are.

    ``buckets`` should give files of some hundred megabytes. Rows are dealt out first, so that each bucket is one file.
    """
    out = dict(tables)
    for name in ORDER_KEYED:
        if name in tables:
            spark = tables[name].sparkSession
            writer = tables[name].repartition(buckets, "order_id").write.bucketBy(buckets, "order_id").sortBy("order_id")
            out[name] = _saved(writer, spark, f"{base}/{name}")
    return out


def _saved(writer, spark: SparkSession, path: str) -> DataFrame:
    table = f"bucketed_{uuid.uuid4().hex}"
    writer.option("path", path).saveAsTable(table)
    return spark.table(table)


def open_bucketed(spark: SparkSession, base: str, buckets: int) -> dict[str, DataFrame]:
    """The tables of an earlier ``write_bucketed``, made known to this session with their buckets."""
    out = {}
    for name in ORDER_KEYED:
        schema = spark.read.parquet(f"{base}/{name}").schema
        table = f"bucketed_{uuid.uuid4().hex}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        spark.sql(
            f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (order_id) SORTED BY (order_id) INTO {buckets} BUCKETS "
            f"LOCATION '{base}/{name}'"
        )
        out[name] = spark.table(table)
    return out
