"""All catalogue queries: importing a module registers its queries."""

from __future__ import annotations

from . import entity_queries, extraction_queries, facet_queries, lifecycle_queries, price_queries, quality_queries, stream_queries, table_queries, text_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
