"""Queries of the engine's own operators and the SQL that must give equal rows."""

from .plans import context_queries, graph_queries, ingest_queries, maintenance_queries, stats_queries  # noqa: F401
from .plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
