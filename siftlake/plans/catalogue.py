"""Named queries of the search engine and their DuckDB equivalents."""

from __future__ import annotations

from siftlake.plans import browse_queries, change_queries, search_queries

_MODULES = (search_queries, browse_queries, change_queries)


def queries() -> dict:
    return {name: query for m in _MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
