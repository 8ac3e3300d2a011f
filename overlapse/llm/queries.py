"""Registered queries of this folder."""

from __future__ import annotations

from overlapse.llm import cluster_queries, leak_queries, packing_queries, quality_queries, set_queries

_MODULES = [cluster_queries, set_queries, packing_queries, leak_queries, quality_queries]

QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
