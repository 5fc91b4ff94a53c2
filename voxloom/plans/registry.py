"""All core queries and their SQL by name."""

from __future__ import annotations

from voxloom.plans import balance_queries, more_queries, table_queries, text_queries

_MODULES = [balance_queries, text_queries, table_queries, more_queries]

QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}
