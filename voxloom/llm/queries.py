"""All queries of this subpackage and their SQL by name."""

from __future__ import annotations

from voxloom.llm import corpus_queries, lookalike_queries, overlap_queries, token_queries, truncation_queries

_MODULES = [overlap_queries, lookalike_queries, corpus_queries, token_queries, truncation_queries]

QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}
