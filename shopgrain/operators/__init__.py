"""Reusable DataFrame operators, independent of the retail tables."""

from .aggregates import count_by, fill_domain, keep_known_keys
from .charts import box_outliers, box_stats, correlation_matrix, histogram, missingness, table_profile
from .dedup import keep_first, keep_latest
from .joins import lookup_join
from .order_stats import at_or_above_quantile, exact_quantiles, lowest_share, values_at_shares
from .prefix import cumulative_before, numbered
from .ranking import rank_labels, top_k
from .sampling import exact_sample, hash_split, stratified_split

__all__ = [
    "at_or_above_quantile", "box_outliers", "box_stats", "correlation_matrix", "count_by", "cumulative_before",
    "exact_quantiles", "exact_sample", "fill_domain", "hash_split", "histogram", "keep_first", "keep_known_keys",
    "keep_latest", "lookup_join", "lowest_share", "missingness", "numbered", "rank_labels", "stratified_split",
    "table_profile", "top_k", "values_at_shares",
]
