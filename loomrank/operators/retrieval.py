"""Postings, sparse, dense and multi-vector scoring, and top-k runs.

A run is (query_id, doc_id, rank, score): ranks follow the score rounded to six places,
then doc_id, so that they do not depend on summation order or on ties.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomrank.functions import text as T

from . import blocks as B

#: Query-side term tables up to this many rows are broadcast; larger ones are shuffled.
BROADCAST_ROWS = 200_000
#: Terms of two documents or more that TF-IDF holds in every task; larger vocabularies are joined.
MAX_VOCABULARY = 3_000_000
Parts = tuple[Column, Callable[[str], list[str]]]


def small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to be small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def top_k(scores: DataFrame, k: int, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    scores = scores.withColumn("score", F.round("score", 6))
    order = W.partitionBy(*by).orderBy(F.desc("score"), F.asc("doc_id"))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def postings(docs: DataFrame, tokens: Column, id_col: str = "doc_id", terms: DataFrame | None = None) -> DataFrame:
    """(doc_id, dl, term, tf), of the listed terms if any are given; dl is the length after analysis.

    Terms are filtered before the aggregation, so only their occurrences are shuffled.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), tokens.alias("tokens"))
    rows = rows.select("doc_id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
    if terms is not None:
        rows = rows.join(small(terms.select("term").distinct()), "term", "left_semi")
    return rows.groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))


def query_terms(queries: DataFrame, tokens: Column, id_col: str) -> DataFrame:
    """(query_id, term, qtf)."""
    rows = queries.select(F.col(id_col).alias("query_id"), F.explode(tokens).alias("term"))
    return rows.groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def collection(docs: DataFrame, tokens: Column) -> DataFrame:
    """One row: n documents and their mean length."""
    return docs.agg(F.count("*").alias("n"), F.avg(F.size(tokens)).alias("avgdl"))


def bm25_weights(post: DataFrame, stats: DataFrame, terms: DataFrame | None = None, k1: Column | float = 1.2, b: Column | float = 0.75) -> DataFrame:
    """(doc_id, term, weight, idf) for the listed terms (all if none): weight holds idf once."""
    k1, b = (x if isinstance(x, Column) else F.lit(x) for x in (k1, b))
    if terms is not None:
        post = post.join(small(terms.select("term").distinct()), "term", "left_semi")
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    rows = post.join(df, "term").crossJoin(F.broadcast(stats))
    rows = rows.withColumn("idf", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1))
    part = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b) + k1 * b * F.col("dl") / F.col("avgdl"))
    return rows.withColumn("weight", F.col("idf") * part)


def bm25_scores(qterms: DataFrame, weights: DataFrame, idf_power: int = 2, by: tuple[str, ...] = ()) -> DataFrame:
    """Presence of the query term times idf (idf_power 2) or 1, times the document weight."""
    hit = weights.join(small(qterms), "term")
    value = F.col("idf") * F.col("weight") if idf_power == 2 else F.col("weight")
    return hit.groupBy("query_id", "doc_id", *by).agg(F.sum(value).alias("score"))


def _bm25_cells(docs: DataFrame, queries: DataFrame, doc_tokens: Column, q_tokens: Column, q_id: str, k: int, cells: list[tuple[float, float]], idf_power: int, own: bool = False) -> DataFrame:
    """(cell, query_id, doc_id, rank, score) of all settings; no row for a pair of query and document leaves a task.

    own: each row of ``queries`` has the tokens of a row of ``docs``, so the best document scores as much as that one at least.
    """
    docs = B.spread(docs).withColumn("_tokens", doc_tokens)
    df = B.doc_freq(docs, F.col("_tokens")).persist()
    n, avgdl = B.totals(df)
    own = own and k == 1
    merged = B.repeated(queries, q_id) if own else None

    def sides() -> Iterator[B.Side]:
        for side in B.passes(query_terms(queries, q_tokens, q_id), df, n):
            side.cells, side.avgdl = cells, avgdl
            qtf, side.weight = side.weight, side.idf(side.df)[side.term] ** idf_power
            if own:
                side.set_floor(qtf, merged)
            yield side

    found = B.search(docs, F.col("_tokens"), sides(), k)
    df.unpersist()
    return found


def bm25(docs: DataFrame, queries: DataFrame, doc_tokens: Column, q_tokens: Column, q_id: str, k: int, k1: float = 1.2, b: float = 0.75, idf_power: int = 2) -> DataFrame:
    return _bm25_cells(docs, queries, doc_tokens, q_tokens, q_id, k, [(k1, b)], idf_power).drop("cell")


def bm25_grid(docs: DataFrame, queries: DataFrame, doc_tokens: Column, q_tokens: Column, q_id: str, k: int, grid: list[tuple[float, float]], own: bool = False) -> DataFrame:
    """All (k1, b) settings in one pass over the documents; own: the queries are documents of the collection."""
    found = _bm25_cells(docs, queries, doc_tokens, q_tokens, q_id, k, grid, 2, own)
    cells = F.broadcast(docs.sparkSession.createDataFrame([(i, *c) for i, c in enumerate(grid)], "cell int, k1 double, b double"))
    return found.join(cells, "cell").select("k1", "b", "query_id", "doc_id", "rank", "score")


def tfidf_weights(post: DataFrame, stats: DataFrame, min_df: int = 1) -> DataFrame:
    """(doc_id, term, weight, idf): raw tf times smooth idf, L2-normalised per document."""
    df = post.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= min_df)
    rows = post.join(df, "term").crossJoin(F.broadcast(stats))
    rows = rows.withColumn("idf", F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)
    rows = rows.withColumn("raw", F.col("tf") * F.col("idf"))
    norms = rows.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return rows.join(norms, "doc_id").withColumn("weight", F.col("raw") / F.col("norm"))


def _tfidf_joined(docs: DataFrame, queries: DataFrame, doc_tokens: Column, q_tokens: Column, q_id: str, k: int, min_df: int = 1) -> DataFrame:
    """``tfidf`` by joins, for a vocabulary that no task holds."""
    post, qterms = postings(docs, doc_tokens), query_terms(queries, q_tokens, q_id)
    asked = small(qterms)
    df = post.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= min_df)
    vocab = df.crossJoin(F.broadcast(collection(docs, doc_tokens))).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    #: Query terms carry the squared norm of their query along, so a term's postings meet them once.
    q = vocab.join(asked, "term").withColumn("raw", F.col("qtf") * F.col("idf"))
    q = q.withColumn("wq", F.col("raw") / F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(W.partitionBy("query_id"))))
    listed = small(qterms.select("term").distinct()).withColumn("asked", F.lit(True))
    rows = post.join(vocab, "term").join(listed, "term", "left").withColumn("raw", F.col("tf") * F.col("idf"))
    #: One aggregation gives a document's norm and its postings of query terms.
    mine = F.collect_list(F.when(F.col("asked"), F.struct("term", "raw"))).alias("mine")
    found = rows.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"), mine)
    hit = found.select("doc_id", "norm", F.explode("mine").alias("x")).select("doc_id", "x.term", (F.col("x.raw") / F.col("norm")).alias("weight"))
    scores = hit.join(q.select("query_id", "term", "wq"), "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("wq") * F.col("weight")).alias("score"))
    return top_k(scores, k).select("query_id", "doc_id", "rank", "score")


def tfidf(docs: DataFrame, queries: DataFrame, doc_tokens: Column, q_tokens: Column, q_id: str, k: int, min_df: int = 1, parts: Parts | None = None) -> DataFrame:
    """Cosine of TF-IDF vectors; the query's norm is over terms in the vocabulary.

    Terms of two documents or more are broadcast for the documents' norms; every other term has one document.
    ``parts`` are a document's words and a function that gives a word's terms, all of which are ``doc_tokens``.
    """
    found = _cosine_cells(docs, queries, doc_tokens, q_tokens, q_id, k, min_df, [], parts)
    return _tfidf_joined(docs, queries, doc_tokens, q_tokens, q_id, k, min_df) if found is None else found.drop("cell")


def bm25_tfidf(docs: DataFrame, queries: DataFrame, doc_tokens: Column, q_tokens: Column, q_id: str, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The runs of ``bm25`` and ``tfidf`` in one table with a ranker column, from one count and one search of the documents."""
    plain = docs, queries, doc_tokens, q_tokens, q_id, k
    found = _cosine_cells(*plain, 1, [(k1, b)])
    if found is None:
        parts = bm25(*plain, k1, b).withColumn("ranker", F.lit("bm25")), _tfidf_joined(*plain).withColumn("ranker", F.lit("tfidf"))
        return parts[0].unionByName(parts[1])
    return found.select("query_id", "doc_id", "rank", "score", F.when(F.col("cell") == 0, "bm25").otherwise("tfidf").alias("ranker"))


def _cosine_cells(docs: DataFrame, queries: DataFrame, doc_tokens: Column, q_tokens: Column, q_id: str, k: int, min_df: int, cells: list[tuple[float, float]], parts: Parts | None = None) -> DataFrame | None:
    """(cell, query_id, doc_id, rank, score) of BM25's cells (idf twice), then TF-IDF's; None if no task holds the vocabulary."""
    words, expand = parts or (doc_tokens, None)
    docs = B.spread(docs).withColumn("_tokens", words)
    qterms = query_terms(queries, q_tokens, q_id)
    counted = (B.doc_freq_of_parts(docs, F.col("_tokens"), expand) if expand else B.doc_freq(docs, F.col("_tokens"))).persist()
    (n, avgdl), df = B.totals(counted), counted.where(F.col("df") >= min_df)
    known = df.where("df > 1 and term is not null").select("term", "df").limit(MAX_VOCABULARY + 1).toArrow()
    if known.num_rows > MAX_VOCABULARY:
        counted.unpersist()
        return None

    def sides() -> Iterator[B.Side]:
        for side in B.passes(qterms, df, n):
            rest = known.filter(pc.invert(pc.is_in(known["term"], value_set=side.terms)))
            side.others, side.others_df, side.min_df = rest["term"].combine_chunks(), rest["df"].to_numpy(), min_df
            side.cells, side.avgdl, side.expand = cells, avgdl, expand
            side.set_cosine()
            side.weight = side.idf(side.df)[side.term] ** 2
            yield side

    found = B.search(docs, F.col("_tokens"), sides(), k)
    counted.unpersist()
    return found


def learned_sparse(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Dot product of token-weight maps: docs(doc_id, weights), queries(query_id, weights); zero and NaN weights drop."""
    live = "weight != 0 and not isnan(weight) and term != ''"
    d = docs.select("doc_id", F.explode("weights").alias("term", "weight")).where(live)
    q = queries.select("query_id", F.explode("weights").alias("term", "weight")).where(live).withColumnRenamed("weight", "wq")
    hit = d.join(small(q), "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("wq") * F.col("weight")).alias("score"))
    return top_k(hit, k).select("query_id", "doc_id", "rank", "score")


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2(a: Column | str) -> Column:
    """``a`` over its norm, which is a bound variable: as an expression inside the transform it would be evaluated once an element."""
    n = F.sqrt(dot(a, a))
    norm = F.array(F.when(n == 0, 1.0).otherwise(n))
    return F.element_at(F.transform(norm, lambda m: F.transform(a, lambda x: x.cast("double") / m)), 1)


def dense(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exact cosine top-k of docs(doc_id, vec) for a stated, broadcast query set (query_id, qvec)."""
    d = docs.select("doc_id", l2("vec").alias("vec"))
    q = small(queries.select("query_id", l2("qvec").alias("qvec")))
    scores = d.crossJoin(q).select("query_id", "doc_id", dot("vec", "qvec").alias("score"))
    return top_k(scores, k).select("query_id", "doc_id", "rank", "score")


def centroid(tokens: Column | str, dim: int) -> Column:
    """L2-normalised mean of token vectors, in one pass over them; zeros without tokens."""
    zero = F.array_repeat(F.lit(0.0), dim)
    total = F.aggregate(tokens, zero, lambda s, v: F.zip_with(s, v, lambda x, y: x + y.cast("double")))
    return l2(F.transform(total, lambda x: x / F.greatest(F.size(tokens), F.lit(1))))


def maxsim(docs: DataFrame, queries: DataFrame, k: int, preselect: int, dim: int) -> DataFrame:
    """Late interaction: centroids preselect candidates, then the sum over query tokens of the best document token (0 without tokens)."""
    d = docs.select("doc_id", "tokens", centroid("tokens", dim).alias("vec"))
    q = queries.select("query_id", F.col("tokens").alias("qtokens"), centroid("tokens", dim).alias("qvec"))
    first = dense(d, q, preselect).select("query_id", "doc_id")
    pairs = first.join(small(q.select("query_id", "qtokens")), "query_id").join(d.select("doc_id", "tokens"), "doc_id")
    best = F.transform("qtokens", lambda t: F.coalesce(F.array_max(F.transform("tokens", lambda v: dot(t, v))), F.lit(0.0)))
    scores = pairs.select("query_id", "doc_id", F.aggregate(best, F.lit(0.0), lambda s, x: s + x).alias("score"))
    return top_k(scores, k).select("query_id", "doc_id", "rank", "score")


def pool(tokens: Column | str, dim: int, mode: str = "mean") -> Column:
    """Sentence vector from token vectors: the first token, or their mean."""
    return l2(F.element_at(tokens, 1)) if mode == "cls" else centroid(tokens, dim)


RETRIEVERS = {"bm25": bm25, "tfidf": tfidf, "dense": dense, "maxsim": maxsim, "learned_sparse": learned_sparse}


def analyzer(kind: str, c: str = "text") -> Column:
    """Token array by analyser name: word, word_nostop, word_1_2, char_wb."""
    if kind == "word":
        return T.index_tokens(c)
    if kind == "word_nostop":
        return T.drop_stop_words(T.index_tokens(c))
    if kind == "word_1_2":
        return T.uni_bi(T.index_tokens(c))
    if kind == "char_wb":
        return T.char_wb(c)
    raise ValueError(f"unknown analyser {kind}")
