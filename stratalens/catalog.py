"""The queries over file-metadata tables, by name, and their DuckDB SQL."""

from __future__ import annotations

from .plans import layout_queries, markup_queries, store_queries, variant_queries  # noqa: F401  they add theirs
from .plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
