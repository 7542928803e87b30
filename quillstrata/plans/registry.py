"""Registered queries and the SQL that gives the same rows.

Each module of queries adds its own with the decorator; names and aliases are the same on both sides.
"""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


from . import graph_queries, market_queries, metric_queries, text_queries, vector_queries  # noqa: E402,F401
