"""Table scans and sinks."""

from .bucketed import open_bucketed, write_bucketed
from .readers import (
    Coerced, SourceEmptyError, SourceMissingError, coerce_counted, load_enriched_orders, load_optional, load_tables, scan_csv,
    with_declared_types,
)
from .star_schema import load_star_schema
from .writers import write_enriched_orders, write_small_csv, write_top_tables

__all__ = [
    "Coerced", "SourceEmptyError", "SourceMissingError", "coerce_counted", "load_enriched_orders", "load_optional", "load_star_schema",
    "load_tables", "open_bucketed", "scan_csv", "with_declared_types", "write_bucketed", "write_enriched_orders", "write_small_csv",
    "write_top_tables",
]
