"""The export in instalments: new orders rewrite their months alone.

Two tables are kept by month: the orders' facts, and for each customer of the month what adds up (orders, revenue, last
purchase, scores). A customer's totals are the sums of these partial rows, so nothing of other months is rewritten when a
customer buys again. The enriched table is the facts joined to the totals when it is read.

An order that comes again replaces its row, also if it has moved to another month: the months of known orders among the
new ones are rewritten as well. A repeated instalment changes nothing.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sum_or_zero
from ..operators import keep_known_keys, lookup_join
from ..session import discard, materialize
from ..sources.writers import MONTH_PARTITIONS
from .features import build_order_facts

MONTHS = list(MONTH_PARTITIONS)


def customer_months(facts: DataFrame) -> DataFrame:
    """Per month and customer, what sums up to the customer's totals."""
    return keep_known_keys(facts, "customer_id").groupBy(*MONTHS, "customer_id").agg(
        F.count("order_id").alias("n_orders"), sum_or_zero(F.col("total_order_value")).alias("revenue"),
        F.count("total_order_value").alias("n_values"), F.max("order_purchase_timestamp").alias("last_purchase"),
        F.sum("review_score_latest").alias("score_sum"), F.count("review_score_latest").alias("n_scores"),
    )


def customer_totals(months: DataFrame) -> DataFrame:
    """Customer features from the partial rows of all months."""
    def mean(total: str, count: str):
        return F.try_divide(F.sum(total).cast("double"), F.sum(count).cast("double"))

    return months.groupBy("customer_id").agg(
        F.sum("n_orders").alias("customer_n_orders"), F.sum("revenue").alias("customer_total_revenue"),
        mean("revenue", "n_values").alias("customer_avg_order_value"), F.max("last_purchase").alias("customer_last_purchase"),
        mean("score_sum", "n_scores").alias("customer_review_score_mean"), F.sum("n_scores").alias("customer_review_count"),
    )


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _overwrite_months(rows: DataFrame, path: str) -> None:
    """Replace the months that ``rows`` has, and no other."""
    rows.hint("rebalance", *MONTHS).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*MONTHS).parquet(path)


def export_instalment(spark: SparkSession, tables: Mapping[str, DataFrame], base: str) -> list[tuple[int, int]]:
    """Add the orders of prepared ``tables`` to the export under ``base``; returns the rewritten months.

    ``tables`` holds all items, payments and reviews of the orders in it.
    """
    new = materialize(build_order_facts(tables), "instalment")
    known = _stored(spark, f"{base}/facts")
    touched = new.select(*MONTHS)
    if known is not None:
        moved = known.select("order_id", *MONTHS).join(new.select("order_id"), "order_id", "left_semi").select(*MONTHS)
        touched = touched.unionByName(moved)
    months = [tuple(r) for r in touched.distinct().orderBy(*MONTHS).collect()]  # one row per calendar month
    if not months:
        return []
    rows = new
    if known is not None:
        in_months = F.lit(False)
        for year, month in months:
            in_months = in_months | ((F.col(MONTHS[0]) == year) & (F.col(MONTHS[1]) == month))
        kept = known.where(in_months).join(new.select("order_id"), "order_id", "left_anti")
        rows = materialize(kept.select(*new.columns).unionByName(new), "months")  # read before its months are replaced
    partial = materialize(customer_months(rows), "customers")
    for table, name in ((rows, "facts"), (partial, "customer_months")):
        emptied = [m for m in months if m not in {tuple(r) for r in table.select(*MONTHS).distinct().collect()}]
        _overwrite_months(table, f"{base}/{name}")
        for year, month in emptied:  # every order of the month has moved away
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{name}/{MONTHS[0]}={year}/{MONTHS[1]}={month}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    for table in {id(t): t for t in (new, rows, partial)}.values():
        discard(table)
    return months


def load_export(spark: SparkSession, base: str, customers: DataFrame) -> DataFrame:
    """The enriched orders of an export, with the attributes of cleaned ``customers``."""
    totals = customer_totals(spark.read.parquet(f"{base}/customer_months"))
    return lookup_join(
        spark.read.parquet(f"{base}/facts"), totals.join(customers, "customer_id", "left"), "customer_id", right_suffix="_customer"
    )
