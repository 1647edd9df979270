"""Stream-static search: each micro-batch of queries is scored against a static index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from loomrank.operators import retrieval as R


def bm25_stream(queries: DataFrame, weights: DataFrame, q_tokens, k: int, sink: Callable[[DataFrame, int], None]):
    """Start a query stream(query_id, ...) whose batches of runs go to ``sink``; weights as from ``bm25_weights``."""

    def batch(rows: DataFrame, number: int) -> None:
        qterms = R.query_terms(rows, q_tokens, "query_id")
        sink(R.top_k(R.bm25_scores(qterms, weights), k).select("query_id", "doc_id", "rank", "score"), number)

    return queries.writeStream.foreachBatch(batch)
