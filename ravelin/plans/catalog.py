"""Modules that register queries, and the flagship query."""

from types import SimpleNamespace

from ravelin.plans import search_queries, search_sql, skew_queries
from ravelin.plans.search_queries import flagship  # noqa: F401

MODULES = [SimpleNamespace(queries=search_queries.queries, oracle_sql=search_sql.oracle_sql), skew_queries]
