"""The workflow: clean, assemble, derive features, report, serve and export."""

from .assembly import build_base_orders, translate_categories
from .cleaning import clean_tables
from .features import build_enriched_orders
from .workflow import run_workflow

__all__ = ["build_base_orders", "build_enriched_orders", "clean_tables", "run_workflow", "translate_categories"]
