"""Scans of the input tables, of the enriched table and of optional pre-aggregates."""

from __future__ import annotations

from collections.abc import Callable, Collection, Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import number_or_null, text_or_null, timestamp_or_null, zero_if_null
from ..schemas import ENRICHED_COLUMNS, MULTILINE_TABLES, TABLE_COLUMNS, TABLE_NAMES


class SourceEmptyError(ValueError):
    """A required table holds no rows."""


class SourceMissingError(FileNotFoundError):
    """A required path does not exist; the step that writes it has not run."""


def scan_csv(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Header CSV as text columns, with the usual missing-value tokens read as NULL.

    ``multiline`` makes every file one task, so it is off unless quoted text holds line breaks.
    """
    rows = (
        spark.read.option("header", True)
        .option("multiLine", multiline)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )
    return rows.select(*[text_or_null(F.col(f"`{name}`")).alias(name) for name in rows.columns])


def with_declared_types(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Coerce the columns named in ``types``; others, and already matching ones, stay as they are."""
    actual = dict(df.dtypes)
    if all(actual.get(name, dtype) == dtype for name, dtype in types.items()):
        return df
    return df.select(*[
        _coerce(name, types[name]) if name in types and actual[name] != types[name] else F.col(f"`{name}`")
        for name in df.columns
    ])


def _coerce(name: str, dtype: str):
    value = F.col(f"`{name}`")
    if dtype == "timestamp_ntz":
        value = timestamp_or_null(value)
    elif dtype in ("double", "int", "bigint"):
        value = number_or_null(value, dtype)
    else:
        value = value.try_cast(dtype)
    return value.alias(name)


@dataclass(frozen=True)
class Coerced:
    """Typed rows, how many values of each column were given and could not be read, and those values."""

    rows: DataFrame
    report: DataFrame
    rejects: DataFrame


def coerce_counted(df: DataFrame, types: Mapping[str, str], keys: Sequence[str], stage: Callable[[DataFrame], DataFrame]) -> Coerced:
    """``with_declared_types`` that leaves a trace of what it turned into NULL.

    The rows are read once: the counts are observed while ``stage`` writes the typed rows together with their rejected
    values, which both results then read. ``report`` has a row per column of ``types`` that ``df`` has; ``rejects`` the
    ``keys``, the column's name and the raw text.
    """
    names = [name for name in types if name in df.columns]
    typed = with_declared_types(df, types)
    raw = df.select(*[F.col(f"`{n}`") for n in df.columns], F.struct(*[F.col(f"`{n}`").cast("string").alias(n) for n in names]).alias("_raw"))
    rows = with_declared_types(raw, types)
    lost = {n: F.col("_raw")[n].isNotNull() & F.col(f"`{n}`").isNull() for n in names}
    cells = F.array(*[F.when(lost[n], F.struct(F.lit(n).alias("column"), F.col("_raw")[n].alias("raw"))) for n in names])
    seen = Observation()
    marked = rows.observe(
        seen, *[F.count(F.col("_raw")[n]).alias(f"given_{n}") for n in names], *[F.count_if(lost[n]).alias(f"lost_{n}") for n in names]
    )
    written = stage(marked.select(*[f"`{n}`" for n in typed.columns], F.filter(cells, lambda c: c.isNotNull()).alias("_rejects")))
    counts = seen.get
    report = df.sparkSession.createDataFrame(
        [(n, counts[f"given_{n}"], counts[f"lost_{n}"]) for n in names], "column string, n_given bigint, n_rejected bigint"
    )
    rejects = written.where(F.size("_rejects") > 0).select(*keys, F.inline("_rejects"))
    return Coerced(written.drop("_rejects"), report, rejects)


def load_tables(
    spark: SparkSession,
    base: str,
    fmt: str = "csv",
    paths: Mapping[str, str] | None = None,
    require_rows: bool = True,
    multiline: Collection[str] = MULTILINE_TABLES,
) -> dict[str, DataFrame]:
    """The nine input tables as ``{name: DataFrame}``.

    CSV files of the ``multiline`` tables may hold quoted line breaks and are one task each; pass an empty collection
    if no text does, and they are split like the others.

    ``paths`` overrides the default ``<base>/<name>.csv`` (or ``<base>/<name>.parquet``) per table. Text
    sources arrive typed; a value that does not fit its column is NULL.
    """
    paths = paths or {}
    tables = {}
    for name in TABLE_NAMES:
        path = paths.get(name, f"{base}/{name}.{fmt}")
        try:
            if fmt == "csv":
                rows = scan_csv(spark, path, multiline=name in multiline)
            else:
                rows = spark.read.format(fmt).load(path)
        except AnalysisException as error:
            raise _missing(error, path) from error
        if require_rows and rows.isEmpty():
            raise SourceEmptyError(f"table {name} at {path} is empty")
        tables[name] = with_declared_types(rows, TABLE_COLUMNS[name]) if fmt == "csv" else rows
    return tables


def load_enriched_orders(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The exported order-level table, with a missing delivery delay read as zero days."""
    try:
        if fmt == "csv":
            rows = with_declared_types(scan_csv(spark, path), ENRICHED_COLUMNS)
        else:
            rows = spark.read.format(fmt).load(path)
    except AnalysisException as error:
        raise _missing(error, path) from error
    if "delivery_delay_days" in rows.columns:
        rows = rows.withColumn("delivery_delay_days", zero_if_null(F.col("delivery_delay_days")))
    return rows


def load_optional(spark: SparkSession, path: str | None, schema: str, fmt: str = "csv") -> DataFrame:
    """A small pre-aggregated table, or an empty one with the same columns when it was never written."""
    if path is not None:
        try:
            if fmt == "csv":
                return spark.read.schema(schema).option("header", True).csv(path)
            return spark.read.schema(schema).format(fmt).load(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    return spark.createDataFrame([], schema)


def _missing(error: AnalysisException, path: str) -> Exception:
    if error.getCondition() == "PATH_NOT_FOUND":
        return SourceMissingError(f"no data at {path}; run the step that writes it first")
    return error
