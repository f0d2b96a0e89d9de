"""Datasets behind charts: profiles, histograms, box statistics and correlations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .aggregates import double_or_null
from .joins import lookup_join
from .order_stats import Stage, exact_quantiles


def table_profile(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Name, row count and column count of each table. Counting reads no columns."""
    profile = None
    for name, table in tables.items():
        row = table.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("table_name"), "n_rows", F.lit(len(table.columns)).alias("n_cols")
        )
        profile = row if profile is None else profile.unionByName(row)
    return profile


def missingness(df: DataFrame, top_n: int = 20) -> DataFrame:
    """Missing values per column, most missing first: one aggregation over the table for all columns."""
    types = dict(df.dtypes)

    def absent(name):
        value = F.col(f"`{name}`")
        gone = value.isNull()
        return gone | F.isnan(value) if types[name] in ("double", "float") else gone

    counted = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(absent(name)).alias(f"_missing_{i}") for i, name in enumerate(df.columns)],
    )
    per_column = F.inline(F.array(*[
        F.struct(F.lit(name).alias("column_name"), F.col(f"_missing_{i}").alias("n_missing"))
        for i, name in enumerate(df.columns)
    ]))
    share = F.round(F.try_divide(F.col("n_missing") * 100.0, F.col("_rows")), 2)
    return (
        counted.select("_rows", per_column)
        .select("column_name", "n_missing", share.alias("pct_missing"))
        .orderBy(F.col("pct_missing").desc_nulls_last(), "column_name")
        .limit(top_n)
    )


def histogram(df: DataFrame, column: str, bins: int = 50, stage: Stage | None = None) -> DataFrame:
    """Equal-width bins from the smallest to the largest value; the top edge belongs to the last bin.

    One row per bin, empty bins with zero. If all values are equal there is one bin. The two bounds come to the driver
    first; ``stage`` may write the one column, so that what computes it runs once.
    """
    rows = df.select(double_or_null(column).alias("_x")).where(F.col("_x").isNotNull())
    rows = stage(rows) if stage else rows
    lo, hi = rows.agg(F.min("_x"), F.max("_x")).first()
    if lo is None:
        edges = []
    elif lo == hi:
        edges = [(1, lo, hi)]
    else:
        width = (hi - lo) / bins
        edges = [(k, lo + (k - 1) * width, hi if k == bins else lo + k * width) for k in range(1, bins + 1)]
    all_bins = df.sparkSession.createDataFrame(edges, "bin int, bin_start double, bin_end double")
    number = F.lit(1) if lo == hi else F.least(F.width_bucket("_x", F.lit(lo), F.lit(hi), F.lit(bins)), F.lit(bins)).cast("int")
    counts = rows.groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("_count"))
    return all_bins.join(counts, "bin", "left").select(
        "bin", "bin_start", "bin_end", F.coalesce("_count", F.lit(0)).alias("n_rows")
    )


def _with_fences(df: DataFrame, value: str, by: str, reach: float, stage: Stage | None) -> DataFrame:
    rows = df.select(by, double_or_null(value).alias(value)).dropna()  # two columns, read several times
    rows = stage(rows) if stage else rows
    quartiles = exact_quantiles(rows, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, [by], stage)
    spread = F.col("q3") - F.col("q1")
    fences = quartiles.select(
        "*", (F.col("q1") - reach * spread).alias("_low"), (F.col("q3") + reach * spread).alias("_high")
    )
    return lookup_join(rows, fences, by)


def box_stats(df: DataFrame, value: str, by: str, reach: float = 1.5, stage: Stage | None = None) -> DataFrame:
    """Quartiles per group, whiskers at the last points within ``reach`` interquartile ranges, outlier count."""
    inside = F.col(value).between(F.col("_low"), F.col("_high"))
    return _with_fences(df, value, by, reach, stage).groupBy(by).agg(
        F.count(value).alias("n_rows"),
        F.max("q1").alias("q1"),
        F.max("median").alias("median"),
        F.max("q3").alias("q3"),
        F.min(F.when(inside, F.col(value))).alias("whisker_low"),
        F.max(F.when(inside, F.col(value))).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"),
    )


def box_outliers(df: DataFrame, value: str, by: str, reach: float = 1.5, stage: Stage | None = None) -> DataFrame:
    """The points beyond the whiskers. ``stage`` may write the two columns, which are read several times."""
    fenced = _with_fences(df, value, by, reach, stage)
    return fenced.where(~F.col(value).between(F.col("_low"), F.col("_high"))).select(by, value)


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair as (col_a, col_b, corr), from rows where both are present.

    Each row is unfolded into its complete pairs, which one small aggregation folds up again before anything is
    shuffled. A pair without variation, or without complete rows, has no correlation: NULL.
    """
    columns = [name for name in columns if name in df.columns]
    numbers = df.select(*[double_or_null(name).alias(name) for name in columns])
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    unfolded = numbers.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("pair"), F.col(a).alias("x"), F.col(b).alias("y")) for i, (a, b) in enumerate(pairs)
    ])))
    spread = F.sqrt(F.regr_sxx("x", "y")) * F.sqrt(F.regr_syy("x", "y"))
    measured = unfolded.groupBy("pair").agg(F.try_divide(F.regr_sxy("x", "y"), spread).alias("corr"))
    cells = F.array(*[
        F.array(*[
            F.struct(F.lit(x).alias("col_a"), F.lit(y).alias("col_b")) for x, y in dict.fromkeys([(a, b), (b, a)])
        ])
        for a, b in pairs
    ])
    return measured.select(F.explode(cells[F.col("pair")]).alias("cell"), "corr").select("cell.*", "corr")
