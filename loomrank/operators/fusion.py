"""Rank and score fusion, expansion by feedback, reranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomrank.functions import text as T

from .retrieval import small, top_k


def tagged(runs: dict[str, DataFrame]) -> DataFrame:
    """One run table with a ranker column."""
    return reduce(DataFrame.unionByName, (r.withColumn("ranker", F.lit(n)) for n, r in runs.items()))


def _weight(weights: dict[str, float]) -> Column:
    """The weight of a row's ranker; a ranker without one is an error."""
    name = F.col("ranker")
    w = F.element_at(F.create_map(*(F.lit(x) for p in weights.items() for x in p)), name)
    return F.coalesce(w, F.raise_error(F.concat(F.lit("no weight for ranker "), F.coalesce(name, F.lit("null")))).cast("double"))


def rrf(runs: DataFrame, weights: dict[str, float], k: int, constant: int = 60, rank_base: int = 0) -> DataFrame:
    """Reciprocal rank fusion; rank_base 0 counts the best as rank 0."""
    w = _weight(weights)
    scores = runs.groupBy("query_id", "doc_id").agg(F.sum(w / (constant + F.col("rank") - 1 + rank_base)).alias("score"))
    return top_k(scores, k).select("query_id", "doc_id", "rank", "score")


def normalize(runs: DataFrame, method: str) -> DataFrame:
    """Adds norm: minmax, zscore (population, then minmax) or rank_rrf (1-based), per ranker and query."""
    by = W.partitionBy("ranker", "query_id")

    def minmax(df: DataFrame, c: str) -> DataFrame:
        lo, hi = F.min(c).over(by), F.max(c).over(by)
        return df.withColumn("norm", F.when(hi - lo < 1e-9, 0.0).otherwise((F.col(c) - lo) / (hi - lo)))

    if method == "minmax":
        return minmax(runs, "score")
    if method == "zscore":
        sd = F.stddev_pop("score").over(by)
        z = F.when(sd < 1e-9, 0.0).otherwise((F.col("score") - F.avg("score").over(by)) / sd)
        return minmax(runs.withColumn("z", z), "z").drop("z")
    if method == "rank_rrf":
        return runs.withColumn("norm", 1 / (60.0 + F.col("rank")))
    raise ValueError(f"unknown normalisation {method}")


def fuse(normed: DataFrame, weights: dict[str, float], k: int, bonus: DataFrame | None = None) -> DataFrame:
    """Weighted sum of normalised scores (missing: 0), plus a bonus per pair where given."""
    w = _weight(weights)
    scores = normed.groupBy("query_id", "doc_id").agg(F.sum(w * F.col("norm")).alias("score"))
    if bonus is not None:
        scores = scores.join(bonus, ["query_id", "doc_id"], "left").withColumn("score", F.col("score") + F.coalesce("bonus", F.lit(0.0)))
    return top_k(scores, k).select("query_id", "doc_id", "rank", "score")


def numeric_bonus(q: Column | str, d: Column | str, exact: float, overlap: float) -> Column:
    """exact if the query's numbers are non-empty and all in the document's; overlap times their shared share."""
    q, d = F.array_distinct(q), F.array_distinct(d)
    shared = F.size(F.array_intersect(q, d))
    return F.when(F.size(q) == 0, 0.0).otherwise(exact * (shared == F.size(q)).cast("double") + overlap * shared / F.size(q))


def sweep(normed: DataFrame, configs: list[tuple[int, str, float]], gold: DataFrame, n_queries: int) -> DataFrame:
    """(config, acc1) of every weight vector in one aggregation; configs are (config, ranker, weight) rows."""
    cells = F.broadcast(normed.sparkSession.createDataFrame(configs, "config int, ranker string, w double"))
    scores = normed.join(cells, "ranker").groupBy("config", "query_id", "doc_id").agg(F.sum(F.col("w") * F.col("norm")).alias("score"))
    best = top_k(scores, 1, ("config", "query_id"))
    hit = best.join(gold, ["query_id", "doc_id"], "left_semi").groupBy("config").agg((F.count("*") / n_queries).alias("acc1"))
    names = normed.sparkSession.createDataFrame(sorted({(c[0],) for c in configs}), "config int")
    return names.join(hit, "config", "left").select("config", F.round(F.coalesce("acc1", F.lit(0.0)), 6).alias("acc1"))


def feedback(run: DataFrame, post: DataFrame, m: int, n: int, mu: float | None = 2000.0) -> DataFrame:
    """(query_id, term, p, rank): expansion terms of the top m documents; mu None is Rocchio, else RM3."""
    seen = post.join(small(run.where(F.col("rank") <= m).select("query_id", "doc_id")), "doc_id")
    tf = seen.groupBy("query_id", "term").agg(F.sum("tf").alias("tf")).where(~F.col("term").rlike(r"^\d$"))
    total = seen.groupBy("query_id").agg(F.sum("tf").alias("all_tf"))
    rows = tf.join(total, "query_id")
    if mu is None:
        p = F.col("tf") / F.col("all_tf")
    else:
        cf = post.groupBy("term").agg(F.sum("tf").alias("cf"))
        size = post.agg(F.sum("tf").alias("tokens"))
        rows = rows.join(cf, "term").crossJoin(F.broadcast(size))
        p = (F.col("tf") + mu * F.col("cf") / F.col("tokens")) / (F.col("all_tf") + mu)
    rows = rows.withColumn("p", F.round(p, 9))
    order = W.partitionBy("query_id").orderBy(F.desc("p"), "term")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("query_id", "term", "p", "rank")


def mixed_terms(qterms: DataFrame, expansion: DataFrame, beta: float) -> DataFrame:
    """Query terms and expansion terms repeated floor(p / pmax * beta * 30) times; those of 0 drop."""
    top = F.max("p").over(W.partitionBy("query_id"))
    extra = expansion.withColumn("qtf", F.floor(F.col("p") / top * beta * 30).cast("long")).where("qtf > 0")
    both = qterms.select("query_id", "term", "qtf").unionByName(extra.select("query_id", "term", "qtf"))
    return both.groupBy("query_id", "term").agg(F.sum("qtf").alias("qtf"))


def tiebreak(run: DataFrame, features: DataFrame, w_numbers: float = 1.0, w_values: float = 0.5) -> DataFrame:
    """score + weighted Jaccards of number strings and values; rows without features get no bonus; old rank breaks ties."""
    rows = run.join(features, ["query_id", "doc_id"], "left")
    empty = F.array().cast("array<string>")
    f = {c: F.coalesce(c, empty) for c in ("q_numbers", "d_numbers", "q_values", "d_values")}
    adj = F.col("score") + w_numbers * T.jaccard(f["q_numbers"], f["d_numbers"]) + w_values * T.jaccard(f["q_values"], f["d_values"])
    rows = rows.withColumn("adjusted", F.round(adj, 6))
    order = W.partitionBy("query_id").orderBy(F.desc("adjusted"), "rank")
    return rows.withColumn("new_rank", F.row_number().over(order)).select("query_id", "doc_id", "adjusted", F.col("new_rank").alias("rank"))


def rerank(run: DataFrame, scores: DataFrame, depth: int, alpha: float | None = None) -> DataFrame:
    """Order the first ``depth`` by the pair score (alpha None) or by alpha * pair + (1 - alpha) * raw."""
    rows = run.where(F.col("rank") <= depth).join(scores, ["query_id", "doc_id"])
    value = F.col("pair_score") if alpha is None else alpha * F.col("pair_score") + (1 - alpha) * F.col("score")
    rows = rows.select("query_id", "doc_id", value.alias("score"))
    return top_k(rows, depth).select("query_id", "doc_id", "rank", "score")


def uncached(pairs: DataFrame, cache: DataFrame) -> DataFrame:
    """Pairs that the score cache does not hold."""
    return pairs.join(cache, ["query_id", "doc_id"], "left_anti")
