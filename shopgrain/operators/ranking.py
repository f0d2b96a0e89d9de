"""Top-k reports. Ties are broken by a unique key, so a report is the same in every run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import padded_label


def top_k(df: DataFrame, by: str, key: str, k: int) -> DataFrame:
    """The ``k`` rows with the largest ``by``; missing values rank last. Each task keeps only ``k`` rows."""
    return df.orderBy(F.col(by).desc_nulls_last(), F.col(key)).limit(k)


def rank_labels(best: DataFrame, by: str, key: str, label: str, prefix: str = "C") -> DataFrame:
    """``C01``, ``C02``, … in rank order, for a result of ``top_k``: the window sees only those ``k`` rows."""
    window = Window.orderBy(F.col(by).desc_nulls_last(), F.col(key))
    return best.withColumn(label, padded_label(prefix, F.row_number().over(window)))
