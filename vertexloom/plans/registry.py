"""All registered queries and their SQL."""

from __future__ import annotations

from vertexloom.plans import queries as graph_queries


def queries() -> dict:
    return dict(graph_queries.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(graph_queries.SQL)
