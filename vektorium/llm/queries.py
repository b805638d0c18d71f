"""Named queries of the operators for training data, and their SQL where SQL can express them."""

from __future__ import annotations

from vektorium.llm import text_queries, value_queries, vector_queries

_MODULES = (vector_queries, value_queries, text_queries)

QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}
