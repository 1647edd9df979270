"""Two-level metrics, rank analytics, and paired statistics over runs.

``gold`` is (query_id, gold_id, gold_parent); ``parents`` is (doc_id, parent).  A run that
lacks a query's answers never shrinks the query set: denominators come from ``gold``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def judged(run: DataFrame, gold: DataFrame, parents: DataFrame) -> DataFrame:
    """Candidates with item and parent relevance."""
    rows = run.join(gold, "query_id").join(parents, "doc_id", "left")
    return rows.select(
        *(c for c in run.columns),
        "gold_id",
        "gold_parent",
        "parent",
        (F.col("doc_id") == F.col("gold_id")).alias("rel_item"),
        F.coalesce(F.col("parent") == F.col("gold_parent"), F.lit(False)).alias("rel_parent"),
    )


def per_query(cands: DataFrame, gold: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """First relevant ranks and discounted gains at 10 per query (null ranks: missed)."""
    aggs = []
    for t in ("item", "parent"):
        rel = F.col(f"rel_{t}")
        aggs.append(F.min(F.when(rel, F.col("rank"))).alias(f"first_{t}"))
        aggs.append(F.sum(F.when(rel & (F.col("rank") <= 10), 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias(f"dcg_{t}"))
    found = cands.groupBy(*by, "query_id").agg(*aggs)
    if by:
        gold = gold.crossJoin(F.broadcast(cands.select(*by).distinct()))
    return gold.join(found, [*by, "query_id"], "left").fillna(0.0, ["dcg_item", "dcg_parent"])


def stacked(summary: DataFrame, siblings: DataFrame) -> DataFrame:
    """One row per query and target: first, ndcg; siblings is (gold_parent, n) for the parent's ideal gain."""
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(10)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    rows = summary.join(siblings, "gold_parent", "left").withColumn("ideal", F.coalesce(ideal, F.lit(1.0)))
    parts = F.array(
        F.struct(F.lit("item").alias("target"), F.col("first_item").alias("first"), F.col("dcg_item").alias("ndcg")),
        F.struct(F.lit("parent").alias("target"), F.col("first_parent").alias("first"), (F.col("dcg_parent") / F.col("ideal")).alias("ndcg")),
    )
    keep = [c for c in summary.columns if c not in ("first_item", "first_parent", "dcg_item", "dcg_parent")]
    return rows.select(*keep, F.explode(parts).alias("x")).select(*keep, "x.*")


def hit_rate(first: Column | str, k: int) -> Column:
    return F.round(F.avg(F.when(F.col(first) <= k, 1.0).otherwise(0.0)), 6)


def metric_columns(first: str = "first", ndcg: str | None = "ndcg", mrr_cut: int | None = None) -> list[Column]:
    rr = F.coalesce(1.0 / F.col(first), F.lit(0.0))
    if mrr_cut:
        rr = F.when(F.col(first) <= mrr_cut, rr).otherwise(0.0)
    out = [
        F.count("*").alias("queries"),
        hit_rate(first, 1).alias("acc1"),
        hit_rate(first, 5).alias("recall5"),
        hit_rate(first, 10).alias("recall10"),
        F.round(F.avg(rr), 6).alias("mrr"),
    ]
    return out + ([F.round(F.avg(ndcg), 6).alias("ndcg10")] if ndcg else [])


def metrics_by_scope(rows: DataFrame, flag: str) -> DataFrame:
    """Metrics by target, overall and by a flag, in one GROUPING SETS aggregation; an empty scope is absent."""
    scope = F.when(F.grouping(flag) == 1, "overall").otherwise(F.when(F.col(flag), "flagged").otherwise("unflagged"))
    return (
        rows.groupingSets([["target"], ["target", flag]], "target", flag)
        .agg(scope.alias("scope"), *metric_columns())
        .drop(flag)
    )


def rank_bucket(rank: Column | str) -> Column:
    r = F.col(rank) if isinstance(rank, str) else rank
    out = F.when(r.isNull(), "miss").when(r == 1, "1")
    for lo, hi in ((2, 5), (6, 10), (11, 20), (21, 50), (51, 100)):
        out = out.when(r.between(lo, hi), f"{lo}-{hi}")
    return out.otherwise("miss")


def rank_cdf(ranks: DataFrame, by: str, rank: str) -> DataFrame:
    """(by, rank, cdf): queries are counted by rank first, so the window holds one row a rank."""
    counts = ranks.where(F.col(rank).isNotNull()).groupBy(by, F.col(rank).alias("rank")).agg(F.count("*").alias("n"))
    all_of = W.partitionBy(by)
    below = F.sum("n").over(all_of.orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    return counts.select(by, "rank", F.round(below / F.sum("n").over(all_of), 6).alias("cdf"))


def success_overlap(hits: DataFrame) -> DataFrame:
    """hits(method, query_id): both, either and Jaccard for every pair of methods."""
    size = hits.groupBy("method").agg(F.count("*").alias("n"))
    a, b = (hits.select(F.col("method").alias("m" + s), "query_id") for s in "ab")
    both = a.join(b, "query_id").groupBy("ma", "mb").agg(F.count("*").alias("both"))
    rows = both.join(size.select(F.col("method").alias("ma"), F.col("n").alias("na")), "ma").join(
        size.select(F.col("method").alias("mb"), F.col("n").alias("nb")), "mb"
    )
    either = F.col("na") + F.col("nb") - F.col("both")
    return rows.select("ma", "mb", "both", either.alias("either"), F.round(F.col("both") / either, 6).alias("jaccard"))


def error_type(q_numbers: Column, p_numbers: Column, duplicate: Column, similarity: Column, in_top: Column) -> Column:
    """Kinds of a wrong first answer, in order of priority."""
    return (
        F.when((F.size(q_numbers) > 0) & (F.size(p_numbers) > 0) & (q_numbers != p_numbers), "numeric mismatch")
        .when(duplicate, "near-duplicate")
        .when(similarity > 0.7, "lexical confusion")
        .when(in_top, "ranking failure")
        .otherwise("other")
    )


def holm(p: DataFrame) -> DataFrame:
    """Step-down correction of (name, p): running maximum of (m - rank + 1) p, capped at 1."""
    order = W.orderBy("p", "name")
    m = F.count("*").over(W.partitionBy())
    raw = p.withColumn("raw", (m - F.row_number().over(order) + 1) * F.col("p"))
    run = F.max("raw").over(order.rowsBetween(W.unboundedPreceding, 0))
    return raw.select("name", "p", F.round(F.least(run, F.lit(1.0)), 9).alias("p_holm"))


def benjamini_hochberg(p: DataFrame) -> DataFrame:
    """Step-up correction of (name, p): running minimum of m p / rank from the largest, capped at 1."""
    m = F.count("*").over(W.partitionBy())
    raw = p.withColumn("raw", m * F.col("p") / F.row_number().over(W.orderBy("p", "name")))
    run = F.min("raw").over(W.orderBy(F.desc("p"), F.desc("name")).rowsBetween(W.unboundedPreceding, 0))
    return raw.select("name", "p", F.round(F.least(run, F.lit(1.0)), 9).alias("p_bh"))


def bootstrap(diffs: DataFrame, draws: int = 10_000, seed: int = 13) -> DataFrame:
    """Paired bootstrap of per-query differences (column d, any real numbers), grouped by pair.

    Equal differences are counted first, and a resample is a multinomial draw of those counts,
    so a pair's task holds its distinct differences and not its queries.  two_sided is the centred
    test, one_sided the share of draws at or below zero with one added to both sides.
    """
    import numpy as np
    import pandas as pd

    cells = diffs.groupBy("pair", F.col("d").cast("double").alias("d")).agg(F.count("*").alias("n"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("d")
        d, n, pair = pdf["d"].to_numpy(), pdf["n"].to_numpy(), pdf["pair"].iloc[0]
        total, rng = int(n.sum()), np.random.default_rng([seed, *pair.encode()])
        step = max(1, 2_000_000 // len(d))
        means = np.concatenate([rng.multinomial(total, n / total, size=min(step, draws - lo)) @ d for lo in range(0, draws, step)]) / total
        diff = float(n @ d) / total
        two = float((np.abs(means - diff) >= abs(diff) - 1e-12).mean())
        one = (int((means <= 1e-12).sum()) + 1) / (draws + 1)
        lo, hi = np.quantile(means, [0.025, 0.975])
        return pd.DataFrame([(pair, total, diff, two, one, lo, hi)], columns=["pair", "n", "diff", "two_sided", "one_sided", "ci_low", "ci_high"])

    return cells.groupBy("pair").applyInPandas(run, "pair string, n long, diff double, two_sided double, one_sided double, ci_low double, ci_high double")


def against_best(acc: DataFrame, pairs: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Leaderboard of (method, acc1) with each method's difference to the best one.

    ``pairs`` is (m1, m2, delta, ci_low, ci_high, p_raw, p_holm, p_bh) with delta = m1 - m2, in either order of a
    pair; one stored as (method, best) is turned round.  The best method (ties: first by name) differs from
    itself by 0 with p 0; a method without a pair has nulls and no mark.
    """
    best = acc.orderBy(F.desc("acc1"), "method").limit(1).select(F.col("method").alias("best"))
    turned = pairs.select(
        F.col("m2").alias("best"), F.col("m1").alias("method"), (-F.col("delta")).alias("delta"), (-F.col("ci_high")).alias("ci_low"),
        (-F.col("ci_low")).alias("ci_high"), "p_raw", "p_holm", "p_bh",
    )
    both = pairs.select(F.col("m1").alias("best"), F.col("m2").alias("method"), "delta", "ci_low", "ci_high", "p_raw", "p_holm", "p_bh").unionByName(turned)
    rows = acc.crossJoin(F.broadcast(best)).join(both, ["best", "method"], "left")
    own = F.col("method") == F.col("best")
    zero = lambda c: F.when(own, F.lit(0.0)).otherwise(F.col(c)).alias(c)
    numbers = [zero(c) for c in ("delta", "ci_low", "ci_high", "p_raw", "p_holm", "p_bh")]
    mark = lambda c: F.coalesce(own | (F.col(c) < alpha), F.lit(False))
    return rows.select("method", "acc1", *numbers, mark("p_holm").alias("sig_holm"), mark("p_bh").alias("sig_bh"))


def single_match(places: DataFrame, k: int = 10) -> DataFrame:
    """One row for (query_id, place) with the place of the only right document, null if it was not found.

    success, mrr and perfect are over all queries, mean and median place over the found ones; distribution holds the
    share of each place from 1 to k.
    """
    p = F.when(F.col("place") <= k, F.col("place"))
    share = lambda c: F.round(F.avg(c), 6)
    at = lambda i: share(F.coalesce(p == i, F.lit(False)).cast("int"))
    return places.agg(
        share(p.isNotNull().cast("int")).alias("success"), share(F.coalesce(1 / p, F.lit(0.0))).alias("mrr"), F.round(F.avg(p), 6).alias("mean_place"),
        F.median(p).alias("median_place"), at(1).alias("perfect"), F.array(*[at(i) for i in range(1, k + 1)]).alias("distribution"),
    )


def family_best(acc: DataFrame, family: Column | str) -> DataFrame:
    """(family, method, acc1) of each family's best method; ties: the first by name."""
    best = F.min_by(F.struct("method", "acc1"), F.struct(-F.col("acc1"), "method")).alias("x")
    return acc.groupBy((F.col(family) if isinstance(family, str) else family).alias("family")).agg(best).select("family", "x.*")


def latency_accuracy(latency: DataFrame, acc: DataFrame) -> DataFrame:
    """(method, mean_ms, p95_ms, acc1) from (method, ms) per query and (method, acc1); methods in both."""
    times = latency.groupBy("method").agg(F.avg("ms").alias("mean_ms"), F.percentile("ms", F.lit(0.95)).alias("p95_ms"))
    return times.join(acc.select("method", "acc1"), "method")


def spearman(rows: DataFrame, a: str, b: str, key: str) -> DataFrame:
    """Rank correlation of two columns on ordinal ranks (ties by key); null below three rows."""
    ranked = rows.select(
        F.row_number().over(W.orderBy(F.desc(a), key)).alias("ra"), F.row_number().over(W.orderBy(F.desc(b), key)).alias("rb")
    )
    n = F.count("*")
    rho = 1 - 6 * F.sum((F.col("ra") - F.col("rb")) ** 2) / (n * (n * n - 1))
    return ranked.agg(n.alias("n"), F.round(F.when(n >= 3, rho), 6).alias("rho"))
