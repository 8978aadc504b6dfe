"""All queries of the core, by name."""

from __future__ import annotations

from codestrata.plans import code_queries, data_queries, diff_queries, export_queries, graph_queries, line_queries, metric_queries, search_queries, store_queries, tool_queries

_MODULES = [data_queries, graph_queries, metric_queries, diff_queries, line_queries, search_queries, store_queries, export_queries, code_queries, tool_queries]


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.SQL.items()}
