"""Column expressions: null handling, parsing, time, distance, labels and hashing."""

from .geo import haversine_km
from .hashing import hash_hex, hash_rank
from .nulls import false_if_null, finite_or_null, nan_to_null, safe_ratio, sum_or_zero, zero_if_null
from .parsing import number_or_null, text_or_null, timestamp_or_null
from .text import decimals, padded_label, percent, thousands
from .time import days_between, month_start

__all__ = [
    "days_between", "decimals", "false_if_null", "finite_or_null", "hash_hex", "hash_rank", "haversine_km",
    "month_start", "nan_to_null", "number_or_null", "padded_label", "percent", "safe_ratio", "sum_or_zero",
    "text_or_null", "thousands", "timestamp_or_null", "zero_if_null",
]
