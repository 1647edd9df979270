"""Queries of metrics, error analysis, statistics and collection audits, with their oracles."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomrank.functions import text as T
from loomrank.operators import audit as A
from loomrank.operators import evaluation as E
from loomrank.operators import retrieval as R

from . import sql as S
from .retrieval_queries import bench, bm25_self, docs, self_queries, self_runs, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
K = 20
RUN = S.bm25("run", S.SELF, K)
BASE = "WITH" + RUN + "," + S.JUDGED


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def _gold(spark, sf):
    return docs(spark, sf).where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("doc_id").alias("gold_id"), F.col("source").alias("gold_parent"))


def _cands(spark, sf, run=None):
    run = bm25_self(spark, sf, K) if run is None else run
    return E.judged(run, _gold(spark, sf), docs(spark, sf).select("doc_id", F.col("source").alias("parent")))


def _summary(spark, sf):
    return E.per_query(_cands(spark, sf), _gold(spark, sf))


def _siblings(spark, sf):
    return docs(spark, sf).groupBy(F.col("source").alias("gold_parent")).agg(F.count("*").alias("n"))


def _stacked(spark, sf):
    return E.stacked(_summary(spark, sf), _siblings(spark, sf))


@query(BASE + f" SELECT target, {S.METRICS}, round(avg(ndcg), 6) AS ndcg10 FROM stk GROUP BY target")
def metrics_dual(spark, sf):
    return _stacked(spark, sf).groupBy("target").agg(*E.metric_columns())


_FLAG = "fl AS (SELECT stk.*, regexp_matches(text, '[0-9]') AS has_num FROM stk JOIN documents ON doc_id = query_id)"


@query(BASE + f", {_FLAG} SELECT target, CASE WHEN grouping(has_num) = 1 THEN 'overall' WHEN has_num THEN 'flagged' ELSE 'unflagged' END AS scope, {S.METRICS}, round(avg(ndcg), 6) AS ndcg10 FROM fl GROUP BY GROUPING SETS ((target), (target, has_num))")
def metrics_scope_grouping_sets(spark, sf):
    flag = docs(spark, sf).select(F.col("doc_id").alias("query_id"), F.col("text").rlike("[0-9]").alias("has_num"))
    return E.metrics_by_scope(_stacked(spark, sf).join(flag, "query_id"), "has_num")


@query(BASE + " SELECT target, round(avg(CASE WHEN first <= 10 THEN 1.0::DOUBLE / first ELSE 0 END), 6) AS mrr10 FROM stk GROUP BY target")
def mrr10(spark, sf):
    return _stacked(spark, sf).groupBy("target").agg(E.metric_columns(mrr_cut=10)[4].alias("mrr10"))


@query("WITH" + RUN + ", x AS (SELECT query_id, min(rank) FILTER (substr(d.source, 1, 4) = substr(q.source, 1, 4)) AS first FROM run r JOIN documents d USING (doc_id) JOIN documents q ON q.doc_id = query_id GROUP BY query_id)"
       f" SELECT {S.METRICS} FROM (SELECT doc_id AS query_id FROM documents WHERE doc_id % 50 = 0) LEFT JOIN x USING (query_id)")  # fmt: skip
def metrics_prefix_parent(spark, sf):
    d = docs(spark, sf).select("doc_id", T.parent_prefix("source", 4).alias("pp"))
    run = bm25_self(spark, sf, K).join(d, "doc_id").join(d.select(F.col("doc_id").alias("query_id"), F.col("pp").alias("gp")), "query_id")
    first = run.groupBy("query_id").agg(F.min(F.when(F.col("pp") == F.col("gp"), F.col("rank"))).alias("first"))
    return _gold(spark, sf).select("query_id").join(first, "query_id", "left").agg(*E.metric_columns(ndcg=None))


@query(BASE + " SELECT query_id, doc_id, rank, score, gold_id, gold_parent, parent, rel_item, rel_parent FROM cand")
def explode_candidates(spark, sf):
    return _cands(spark, sf)


@query(BASE + " SELECT query_id, gold_id, gold_parent, first_item, first_parent, round(dcg_item, 6) AS dcg_item, round(dcg_parent, 6) AS dcg_parent FROM summ")
def per_query_summary(spark, sf):
    return _summary(spark, sf).withColumns({c: F.round(c, 6) for c in ("dcg_item", "dcg_parent")})


@query(BASE + " SELECT count(*) FILTER (first_item IS NULL) AS missed, count(*) FILTER (first_parent > 1 AND first_parent <= 5) AS near5, count(*) FILTER (first_parent > 1 AND first_parent <= 10) AS near10 FROM summ")
def missed_queries(spark, sf):
    n = lambda c: F.count(F.when(c, 1))
    return _summary(spark, sf).agg(n(F.col("first_item").isNull()).alias("missed"), n(F.col("first_parent").between(2, 5)).alias("near5"), n(F.col("first_parent").between(2, 10)).alias("near10"))


@query(BASE + " SELECT gold_parent, parent, count(*) AS n FROM cand WHERE rank = 1 AND NOT rel_parent GROUP BY ALL ORDER BY n DESC, gold_parent, parent LIMIT 20")
def parent_confusion(spark, sf):
    wrong = _cands(spark, sf).where("rank = 1 and not rel_parent")
    return wrong.groupBy("gold_parent", "parent").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "gold_parent", "parent").limit(20)


@query("WITH" + RUN + " SELECT q.lang AS gold, count(*) FILTER (d.lang = 'de') AS de, count(*) FILTER (d.lang = 'en') AS en, count(*) FILTER (d.lang = 'es') AS es, count(*) FILTER (d.lang = 'fr') AS fr FROM run JOIN documents d USING (doc_id) JOIN documents q ON q.doc_id = query_id WHERE rank <= 5 GROUP BY q.lang")
def confusion_pivot(spark, sf):
    d = docs(spark, sf).select("doc_id", "lang")
    run = bm25_self(spark, sf, K).where("rank <= 5").join(d, "doc_id").join(d.select(F.col("doc_id").alias("query_id"), F.col("lang").alias("gold")), "query_id")
    return run.groupBy("gold").pivot("lang", ["de", "en", "es", "fr"]).agg(F.count(F.lit(1))).fillna(0)


_BUCKET = "CASE WHEN first IS NULL THEN 'miss' WHEN first = 1 THEN '1' WHEN first <= 5 THEN '2-5' WHEN first <= 10 THEN '6-10' WHEN first <= 20 THEN '11-20' WHEN first <= 50 THEN '21-50' WHEN first <= 100 THEN '51-100' ELSE 'miss' END"


@query(BASE + f" SELECT target, {_BUCKET} AS bucket, count(*) AS n FROM stk GROUP BY ALL")
def rank_buckets(spark, sf):
    return _stacked(spark, sf).groupBy("target", E.rank_bucket("first").alias("bucket")).agg(F.count("*").alias("n"))


@query(BASE + " SELECT DISTINCT target, first AS rank, round(cume_dist() OVER (PARTITION BY target ORDER BY first), 6) AS cdf FROM stk WHERE first IS NOT NULL")
def rank_cdf(spark, sf):
    return E.rank_cdf(_stacked(spark, sf), "target", "first")


@query(BASE + " SELECT target, count(*) AS queries, count(first) AS found, round(avg(first), 6) AS mean, quantile_cont(first, 0.5)::DOUBLE AS median, round(count(first) / count(*)::DOUBLE, 6) AS coverage FROM stk GROUP BY target")
def rank_distribution(spark, sf):
    n, found = F.count("*"), F.count("first")
    return _stacked(spark, sf).groupBy("target").agg(n.alias("queries"), found.alias("found"), F.round(F.avg("first"), 6).alias("mean"), F.median("first").alias("median"), F.round(found / n, 6).alias("coverage"))


@query(BASE + """, pos AS (SELECT query_id, rank, rel_parent, sum(rel_parent::INTEGER) OVER (PARTITION BY query_id ORDER BY rank) AS seen FROM cand WHERE rank <= 10),
q AS (SELECT query_id, sum(rel_parent::INTEGER) AS tp, sum(CASE WHEN rel_parent THEN seen / rank::DOUBLE ELSE 0 END) AS ap FROM pos GROUP BY query_id)
SELECT round(avg(tp / 10.0::DOUBLE), 6) AS precision, round(avg(tp / n::DOUBLE), 6) AS recall, round(avg(2.0::DOUBLE * tp / (10 + n)), 6) AS f1, round(avg(CASE WHEN tp > 0 THEN ap / tp ELSE 0 END), 6) AS map FROM q JOIN gold USING (query_id) JOIN sib USING (gold_parent)""")  # fmt: skip
def precision_recall_map(spark, sf):
    w = W.partitionBy("query_id").orderBy("rank")
    c = _cands(spark, sf).where("rank <= 10").withColumn("hit", F.col("rel_parent").cast("int"))
    c = c.withColumn("seen", F.sum("hit").over(w))
    q = c.groupBy("query_id", "gold_parent").agg(F.sum("hit").alias("tp"), F.sum(F.when(F.col("hit") == 1, F.col("seen") / F.col("rank")).otherwise(0.0)).alias("ap"))
    q = q.join(_siblings(spark, sf), "gold_parent")
    tp, n = F.col("tp"), F.col("n")
    return q.agg(F.round(F.avg(tp / 10), 6).alias("precision"), F.round(F.avg(tp / n), 6).alias("recall"), F.round(F.avg(2 * tp / (10 + n)), 6).alias("f1"), F.round(F.avg(F.when(tp > 0, F.col("ap") / tp).otherwise(0.0)), 6).alias("map"))


_TWO = "WITH" + S.bm25("a", S.SELF, 10) + "," + S.tfidf("b", S.SELF, 10) + ", u AS (SELECT 'bm25' AS method, * FROM a UNION ALL SELECT 'tfidf', * FROM b), hits AS (SELECT method, query_id FROM u WHERE rank = 1 AND doc_id = query_id)"


def _hits(spark, sf):
    runs = self_runs(spark, sf, 10)
    return runs.where("rank = 1 and doc_id = query_id").select(F.col("ranker").alias("method"), "query_id")


@query(_TWO + """, n AS (SELECT method, count(*) AS n FROM hits GROUP BY method), p AS (SELECT x.method AS ma, y.method AS mb, count(*) AS "both" FROM hits x JOIN hits y USING (query_id) GROUP BY ALL)
SELECT ma, mb, "both", a.n + b.n - "both" AS either, round("both" / (a.n + b.n - "both")::DOUBLE, 6) AS jaccard FROM p JOIN n a ON a.method = ma JOIN n b ON b.method = mb""")  # fmt: skip
def success_overlap_jaccard(spark, sf):
    return E.success_overlap(_hits(spark, sf))


@query(BASE + " SELECT round(avg(coalesce(rel_item, false)::INTEGER), 6) AS acc1, round(avg(coalesce(rel_parent AND NOT rel_item, false)::INTEGER), 6) AS right_parent_wrong_item, round(avg(coalesce(NOT rel_parent, true)::INTEGER), 6) AS wrong_parent FROM gold g LEFT JOIN (SELECT query_id, rel_item, rel_parent FROM cand WHERE rank = 1) c USING (query_id)")
def error_rates(spark, sf):
    """Shares of all queries; one without an answer has the wrong parent."""
    top = _cands(spark, sf).where("rank = 1").select("query_id", "rel_item", "rel_parent")
    rows = _gold(spark, sf).select("query_id").join(top, "query_id", "left").fillna(False, ["rel_item", "rel_parent"])
    item, parent = F.col("rel_item"), F.col("rel_parent")
    avg = lambda c: F.round(F.avg(c.cast("int")), 6)
    return rows.agg(avg(item).alias("acc1"), avg(parent & ~item).alias("right_parent_wrong_item"), avg(~parent).alias("wrong_parent"))


@query()
def error_types(spark, sf):
    """Kinds of the strongest wrong answers; whole normalised texts are compared."""
    d = docs(spark, sf).select("doc_id", "text")
    w = bm25_self(spark, sf, K).where("rank <= 2 and doc_id != query_id").join(d.withColumnRenamed("text", "dt"), "doc_id")
    w = w.join(d.select(F.col("doc_id").alias("query_id"), F.col("text").alias("qt")), "query_id")
    sim = T.sequence_similarity(T.normalize_text("qt"), T.normalize_text("dt"))
    kind = E.error_type(T.number_strings("qt"), T.number_strings("dt"), F.col("qt") == F.col("dt"), sim, F.lit(True))
    n = w.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy()), 6))


@query(_TWO + " SELECT method, round(count(*) / (SELECT count(*) FROM documents WHERE doc_id % 50 = 0)::DOUBLE, 6) AS acc1, CAST(row_number() OVER (ORDER BY count(*) DESC, method) AS INTEGER) AS place FROM hits GROUP BY method")
def leaderboard(spark, sf):
    n = _gold(spark, sf).count()
    rows = _hits(spark, sf).groupBy("method").agg(F.count("*").alias("c"))
    return rows.select("method", F.round(F.col("c") / n, 6).alias("acc1"), F.row_number().over(W.orderBy(F.desc("c"), "method")).alias("place"))


@query("WITH" + S.bm25("a", S.SELF, 10) + "," + S.tfidf("b", S.SELF, 10) + ", u AS (SELECT 'bm25' AS ranker, * FROM a UNION ALL SELECT 'tfidf', * FROM b), k(k) AS (VALUES (1), (5), (10)) SELECT ranker, k, round(count(DISTINCT query_id) FILTER (doc_id = query_id AND rank <= k) / (SELECT count(*) FROM documents WHERE doc_id % 50 = 0)::DOUBLE, 6) AS coverage FROM u, k GROUP BY ALL")
def gold_coverage(spark, sf):
    n = _gold(spark, sf).count()
    runs = self_runs(spark, sf, 10)
    ks = F.broadcast(spark.createDataFrame([(1,), (5,), (10,)], "k int"))
    hit = F.countDistinct(F.when((F.col("doc_id") == F.col("query_id")) & (F.col("rank") <= F.col("k")), F.col("query_id")))
    return runs.crossJoin(ks).groupBy("ranker", "k").agg(F.round(hit / n, 6).alias("coverage"))


_P = [(f"h{i:02d}", round(0.001 * (i * 37 % 101) + 0.0005, 4)) for i in range(20)]
_PV = "p(name, p) AS (VALUES " + ", ".join(f"('{n}', {v}::DOUBLE)" for n, v in _P) + ")"


@query(f"WITH {_PV}, r AS (SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY p, name) + 1) * p AS raw FROM p) SELECT name, p, round(least(max(raw) OVER (ORDER BY p, name ROWS UNBOUNDED PRECEDING), 1), 9) AS p_holm FROM r")
def holm(spark, sf):
    return E.holm(spark.createDataFrame(_P, "name string, p double"))


@query(f"WITH {_PV}, r AS (SELECT *, count(*) OVER () * p / row_number() OVER (ORDER BY p, name) AS raw FROM p) SELECT name, p, round(least(min(raw) OVER (ORDER BY p DESC, name DESC ROWS UNBOUNDED PRECEDING), 1), 9) AS p_bh FROM r")
def benjamini_hochberg(spark, sf):
    return E.benjamini_hochberg(spark.createDataFrame(_P, "name string, p double"))


@query()
def bootstrap_ci(spark, sf):
    hit = _hits(spark, sf).groupBy("query_id").agg(F.sum(F.when(F.col("method") == "bm25", 1).otherwise(-1)).alias("d"))
    diffs = _gold(spark, sf).select("query_id").join(hit, "query_id", "left").select(F.lit("bm25 - tfidf").alias("pair"), F.coalesce("d", F.lit(0)).alias("d"))
    return E.bootstrap(diffs)


@query("WITH g AS (SELECT source, sum(n_chars) AS a, max(n_chars) AS b FROM documents GROUP BY source), r AS (SELECT row_number() OVER (ORDER BY a DESC, source) AS ra, row_number() OVER (ORDER BY b DESC, source) AS rb FROM g) SELECT count(*) AS n, round(1 - 6 * sum(pow(ra - rb, 2)) / (count(*) * (count(*) * count(*) - 1)), 6) AS rho FROM r")
def spearman_grid(spark, sf):
    g = docs(spark, sf).groupBy("source").agg(F.sum("n_chars").alias("a"), F.max("n_chars").alias("b"))
    return E.spearman(g, "a", "b", "source")


@query("WITH g AS (SELECT lang AS family, source AS config, avg(n_chars) FILTER ((doc_id // 20) % 2 = 0) AS val, avg(n_chars) FILTER ((doc_id // 20) % 2 = 1) AS test FROM documents GROUP BY ALL) SELECT family, arg_max(config, (val, config)) AS chosen, round(max(test) - arg_max(test, (val, config)), 6) AS optimism FROM g WHERE val IS NOT NULL AND test IS NOT NULL GROUP BY family")
def select_on_validation(spark, sf):
    half = lambda r: F.avg(F.when(F.floor(F.col("doc_id") / 20) % 2 == r, F.col("n_chars")))
    g = docs(spark, sf).groupBy(F.col("lang").alias("family"), F.col("source").alias("config")).agg(half(0).alias("val"), half(1).alias("test"))
    key = F.struct("val", "config")
    return g.dropna().groupBy("family").agg(F.max_by("config", key).alias("chosen"), F.round(F.max("test") - F.max_by("test", key), 6).alias("optimism"))


# Collections.
_SIG = "WITH" + S.postings("p") + ", r AS (SELECT doc_id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS raw FROM p_tf JOIN p_df USING (term) CROSS JOIN p_st), w AS (SELECT doc_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS w FROM r), sg AS (SELECT doc_id, md5(string_agg(term || ':' || round(w, 4), ',' ORDER BY term)) AS signature FROM w GROUP BY doc_id)"


def _signatures(spark, sf):
    d = docs(spark, sf)
    return A.vector_signatures(R.tfidf_weights(R.postings(d, R.analyzer("word")), R.collection(d, R.analyzer("word"))))


@query(_SIG + " SELECT count(*) AS \"groups\", CAST(coalesce(sum(n), 0) AS BIGINT) AS docs FROM (SELECT count(*) AS n FROM sg GROUP BY signature HAVING count(*) > 1)")
def duplicate_vectors(spark, sf):
    return A.groups_of(_signatures(spark, sf), "signature").agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("docs"))


@query(_SIG + ", c AS (SELECT count(*) OVER (PARTITION BY signature) AS n FROM sg) SELECT count(*) AS docs, CAST(sum((n > 1)::INTEGER) AS BIGINT) AS affected, round(avg(1.0::DOUBLE / n), 6) AS ceiling FROM c")
def collision_ceiling(spark, sf):
    return A.collision_ceiling(_signatures(spark, sf))


@query("SELECT md5(text) AS h, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_text(spark, sf):
    return A.groups_of(docs(spark, sf).select("text"), "text").select(F.md5("text").alias("h"), "n")


_OV = "round(CASE WHEN len(list_distinct({q})) > 0 THEN len(list_intersect({q}, {d})) / len(list_distinct({q}))::DOUBLE END, 6)"


@query(f"WITH x AS (SELECT q.query_id, q.tokens AS qt, d.tokens AS dt FROM ({S.BENCH}) q JOIN ({S.DOCS}) d ON d.doc_id = q.query_id) SELECT query_id, {_OV.format(q='qt', d='dt')} AS lexical, coalesce({_OV.format(q='qt', d='dt')} = 1, false) AS contained FROM x")
def query_target_overlap(spark, sf):
    """Benchmark items against the documents of the same number."""
    q = bench(spark, sf).select(F.col("item_id").alias("query_id"), T.index_tokens("text").alias("qt"))
    d = docs(spark, sf).select(F.col("doc_id").alias("query_id"), T.index_tokens("text").alias("dt"))
    share, contained = A.overlap(F.col("qt"), F.col("dt"))
    return q.join(d, "query_id").select("query_id", share.alias("lexical"), contained.alias("contained"))


@query("SELECT lang, count(*) AS docs, count(DISTINCT source) AS parents, round(avg(n_chars), 6) AS mean, quantile_cont(n_chars, 0.5)::DOUBLE AS median, round(stddev_samp(n_chars), 6) AS sd FROM documents GROUP BY lang")
def dataset_stats(spark, sf):
    n = "n_chars"
    return docs(spark, sf).groupBy("lang").agg(F.count("*").alias("docs"), F.countDistinct("source").alias("parents"), F.round(F.avg(n), 6).alias("mean"), F.median(n).alias("median"), F.round(F.stddev_samp(n), 6).alias("sd"))


@query("WITH" + S.postings("p") + " SELECT term, df, cf, round(CAST(ln((n - df + 0.5) / (df + 0.5) + 1) AS DOUBLE), 6) AS idf FROM (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM p_tf GROUP BY term) CROSS JOIN p_st")
def term_stats(spark, sf):
    d = docs(spark, sf)
    t = R.postings(d, R.analyzer("word")).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    t = t.crossJoin(F.broadcast(R.collection(d, R.analyzer("word"))))
    return t.select("term", "df", "cf", F.round(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1), 6).alias("idf"))


@query("WITH" + S.postings("p") + f", q AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest(tokens) AS term FROM ({S.SELF}))) SELECT query_id, round(CAST(sum(ln((n - df + 0.5) / (df + 0.5) + 1)) AS DOUBLE), 6) AS mass, count(*) AS terms FROM q JOIN p_df USING (term) CROSS JOIN p_st GROUP BY query_id")
def idf_mass(spark, sf):
    d = docs(spark, sf)
    q = R.query_terms(self_queries(spark, sf), F.col("tokens"), "query_id")
    df = R.postings(d, R.analyzer("word")).groupBy("term").agg(F.count("*").alias("df"))
    rows = df.join(R.small(q), "term").crossJoin(F.broadcast(R.collection(d, R.analyzer("word"))))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    return rows.groupBy("query_id").agg(F.round(F.sum(idf), 6).alias("mass"), F.count("*").alias("terms"))


_SET = "list_sort(list_distinct(regexp_extract_all(lower({}), '[a-z]+')))"


@query(f"WITH x AS (SELECT {_SET.format('p_name')} AS a, {_SET.format('p_type')} AS b FROM part) SELECT round(avg((a = b)::INTEGER), 6) AS aligned, round(avg(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE), 6) AS jaccard FROM x")
def phrase_alignment(spark, sf):
    """How often the words of an item's name are those of its type, and how much of them they share."""
    words = lambda c: F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0))))
    p = table(spark, sf, "part").select(words("p_name").alias("a"), words("p_type").alias("b"))
    return p.agg(F.round(F.avg((F.col("a") == F.col("b")).cast("int")), 6).alias("aligned"), F.round(F.avg(T.jaccard(F.col("a"), F.col("b"))), 6).alias("jaccard"))


@query("SELECT source, (SELECT count(*) FROM documents d2 WHERE d2.source = d.source AND d2.doc_id NOT IN (SELECT doc_id FROM labels)) AS uncovered FROM documents d GROUP BY source")
def source_coverage(spark, sf):
    missing = docs(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left_anti").groupBy("source").agg(F.count("*").alias("uncovered"))
    return docs(spark, sf).select("source").distinct().join(missing, "source", "left").fillna(0)
