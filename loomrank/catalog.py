"""Queries and oracle SQL of the retrieval and evaluation operators."""

from __future__ import annotations

from loomrank.plans import analytics_queries, report_queries, retrieval_queries, text_queries

_PARTS = (retrieval_queries, text_queries, analytics_queries, report_queries)
QUERIES: dict = {n: f for p in _PARTS for n, f in p.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {n: s for p in _PARTS for n, s in p.ORACLE.items()}
