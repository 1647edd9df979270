"""Queries of retrieval, expansion, fusion and reranking, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrank.functions import text as T
from loomrank.operators import blocks as B
from loomrank.operators import fusion as X
from loomrank.operators import models as M
from loomrank.operators import retrieval as R

from . import sql as S

K = 10
GRID = [(k1, b) for k1 in (0.6, 0.8, 1.0, 1.2, 1.5) for b in (0.25, 0.35, 0.5, 0.75, 0.9)]
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark, sf):
    return table(spark, sf, "documents")


def bench(spark, sf):
    return table(spark, sf, "benchmark")


def self_queries(spark, sf) -> DataFrame:
    """Every fiftieth document, by all of its tokens, against all documents."""
    d = docs(spark, sf).where("doc_id % 50 = 0")
    return d.select(F.col("doc_id").alias("query_id"), T.index_tokens("text").alias("tokens"))


def bm25_self(spark, sf, k=K):
    return R.bm25(docs(spark, sf), self_queries(spark, sf), R.analyzer("word"), F.col("tokens"), "query_id", k)


def tfidf_self(spark, sf, k=K):
    return R.tfidf(docs(spark, sf), self_queries(spark, sf), R.analyzer("word"), F.col("tokens"), "query_id", k)


def self_runs(spark, sf, k):
    """``bm25_self`` and ``tfidf_self`` with a ranker column."""
    return R.bm25_tfidf(docs(spark, sf), self_queries(spark, sf), R.analyzer("word"), F.col("tokens"), "query_id", k)


RUN_COLS = "query_id, doc_id, rank, score"


@query("WITH" + S.bm25("run", S.BENCH, K) + f" SELECT {RUN_COLS} FROM run")
def bm25_topk(spark, sf):
    return R.bm25(docs(spark, sf), bench(spark, sf), R.analyzer("word"), R.analyzer("word"), "item_id", K)


@query("WITH" + S.bm25("run", S.BENCH, K, k1=0.8, b=0.35, power=1) + f" SELECT {RUN_COLS} FROM run")
def bm25_single_idf_topk(spark, sf):
    return R.bm25(docs(spark, sf), bench(spark, sf), R.analyzer("word"), R.analyzer("word"), "item_id", K, 0.8, 0.35, idf_power=1)


_UNIBI = "list_concat({t}, coalesce((SELECT list(({t})[i] || ' ' || ({t})[i + 1]) FROM range(1, len({t})) r(i)), []))"


@query(
    "WITH"
    + S.bm25(
        "run",
        f"SELECT item_id AS query_id, {_UNIBI.format(t=S.tokens())} AS tokens FROM benchmark",
        K,
        k1=0.8,
        b=0.35,
        docs=f"SELECT doc_id, {_UNIBI.format(t='tk')} AS tokens FROM (SELECT doc_id, {S.tokens()} AS tk FROM documents)",
    )
    + f" SELECT {RUN_COLS} FROM run"
)
def bm25_unibigram_topk(spark, sf):
    return R.bm25(docs(spark, sf), bench(spark, sf), R.analyzer("word_1_2"), R.analyzer("word_1_2"), "item_id", K, 0.8, 0.35)


_CELLS = ", ".join(f"({k1}::DOUBLE, {b}::DOUBLE)" for k1, b in GRID)


@query(
    "WITH"
    + S.postings("p")
    + f""", q AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest(tokens) AS term FROM ({S.BENCH}))),
cells(k1, b) AS (VALUES {_CELLS}),"""
    + S.ranked(
        "run",
        """SELECT k1, b, query_id, doc_id, sum(pow(ln((n - df + 0.5) / (df + 0.5) + 1), 2) * tf * (k1 + 1) / (tf + k1 * (1 - b) + k1 * b * dl / avgdl)) AS s
        FROM q JOIN p_tf USING (term) JOIN p_df USING (term) CROSS JOIN p_st CROSS JOIN cells GROUP BY ALL""",
        K,
        "k1, b, query_id",
    )
    + " SELECT * FROM run"
)
def bm25_grid(spark, sf):
    return R.bm25_grid(docs(spark, sf), bench(spark, sf), R.analyzer("word"), R.analyzer("word"), "item_id", K, GRID)


@query("WITH" + S.postings("p") + "," + S.tfidf("run", S.BENCH, K) + f" SELECT {RUN_COLS} FROM run")
def tfidf_topk(spark, sf):
    return R.tfidf(docs(spark, sf), bench(spark, sf), R.analyzer("word"), R.analyzer("word"), "item_id", K)


_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


@query(
    "WITH"
    + S.postings("p").replace("GROUP BY ALL)", f"GROUP BY ALL HAVING term NOT IN ({_STOP}))", 1)
    + ","
    + S.tfidf("run", S.BENCH, K)
    + f" SELECT {RUN_COLS} FROM run"
)
def tfidf_nostop_topk(spark, sf):
    """Stop words leave the index only; the query side keeps whatever the vocabulary has."""
    return R.tfidf(docs(spark, sf), bench(spark, sf), R.analyzer("word_nostop"), R.analyzer("word"), "item_id", K)


def _char_sql(table: str, key: str) -> str:
    padded = f"SELECT {key} AS id, ' ' || unnest(string_split_regex(trim(regexp_replace(translate(lower(text), '{S.ACCENTED}', '{S.PLAIN}'), '\\s+', ' ', 'g')), ' ')) || ' ' AS w FROM {table}"
    parts = " UNION ALL ".join(
        f"SELECT id, substr(w, CAST(i AS INTEGER), {n}) AS g FROM (SELECT id, w, unnest(range(1, length(w) - {n} + 2)) AS i FROM pw_{table} WHERE length(w) >= {n})" for n in (3, 4, 5)
    )
    return f"pw_{table} AS ({padded}), g_{table} AS ({parts})"


@query(
    f"""WITH {_char_sql("documents", "doc_id")}, {_char_sql("benchmark", "item_id")},
p_st AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM documents),
p_tf AS (SELECT id AS doc_id, g AS term, count(*) AS tf FROM g_documents GROUP BY ALL),
p_df AS (SELECT term, count(*) AS df FROM p_tf GROUP BY term),"""
    + S.tfidf("run", "SELECT id AS query_id, list(g) AS tokens FROM g_benchmark GROUP BY id", K, min_df=2)
    + f" SELECT {RUN_COLS} FROM run"
)
def tfidf_char_wb_topk(spark, sf):
    return R.tfidf(docs(spark, sf), bench(spark, sf), R.analyzer("char_wb"), R.analyzer("char_wb"), "item_id", K, min_df=2, parts=(T.char_words("text"), T.char_windows))


@query(
    """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), """
    + S.ranked("run", "SELECT q.vec_id AS query_id, d.vec_id AS doc_id, list_cosine_similarity(q.e, d.e) AS s FROM v q, v d WHERE q.vec_id % 50 = 0", K)
    + f" SELECT {RUN_COLS} FROM run"
)
def dense_cosine_topk(spark, sf):
    v = table(spark, sf, "embeddings")
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    return R.dense(v.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec")), q, K)


def _slices(c="embedding"):
    return F.array(*(F.slice(c, 1 + 16 * i, 16) for i in range(4)))


@query()
def maxsim_topk(spark, sf):
    """Four 16-value slices stand for token vectors."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), _slices().alias("tokens"))
    q = v.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id")
    return R.maxsim(v, q, K, 256, 16)


_SPARSE = "SELECT vec_id AS id, 'd' || i AS term, CAST(embedding[i] AS DOUBLE) AS w FROM embeddings, range(1, 65) r(i) WHERE embedding[i] > 0.1::FLOAT"


@query(
    f"WITH e AS ({_SPARSE}),"
    + S.ranked("run", "SELECT q.id AS query_id, d.id AS doc_id, sum(q.w * d.w) AS s FROM e q JOIN e d USING (term) WHERE q.id % 50 = 0 GROUP BY ALL", K)
    + f" SELECT {RUN_COLS} FROM run"
)
def learned_sparse_topk(spark, sf):
    """Components above 0.1 stand for learned term weights."""
    pairs = F.filter(F.transform("embedding", lambda x, i: F.struct(F.concat(F.lit("d"), i + 1).alias("k"), x.alias("v"))), lambda s: s["v"] > F.lit(0.1).cast("float"))
    weights = F.map_from_entries(F.transform(pairs, lambda s: F.struct(s["k"], s["v"].cast("double"))))
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), weights.alias("weights"))
    return R.learned_sparse(v, v.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id"), K)


_SELF_RUNS = S.bm25("a", S.SELF, 20) + "," + S.tfidf("b", S.SELF, 20)


def _self_runs(spark, sf):
    return self_runs(spark, sf, 20)


@query(
    "WITH" + _SELF_RUNS + ","
    + S.ranked("run", "SELECT query_id, doc_id, sum(w / (60.0 + rank - 1)) AS s FROM (SELECT *, 1.0::DOUBLE AS w FROM a UNION ALL SELECT *, 1.5::DOUBLE FROM b) GROUP BY ALL", K)
    + f" SELECT {RUN_COLS} FROM run"
)
def rrf_fusion(spark, sf):
    return X.rrf(_self_runs(spark, sf), {"bm25": 1.0, "tfidf": 1.5}, K)


_UNION = "u AS (SELECT 'bm25' AS ranker, * FROM a UNION ALL SELECT 'tfidf', * FROM b)"
_MINMAX = "CASE WHEN max({c}) OVER w - min({c}) OVER w < 1e-9 THEN 0 ELSE ({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w) END"
_NORM = {
    "minmax": f"n AS (SELECT *, {_MINMAX.format(c='score')} AS norm FROM u WINDOW w AS (PARTITION BY ranker, query_id))",
    "zscore": "z AS (SELECT *, CASE WHEN stddev_pop(score) OVER w < 1e-9 THEN 0 ELSE (score - avg(score) OVER w) / stddev_pop(score) OVER w END AS zs FROM u WINDOW w AS (PARTITION BY ranker, query_id)), "
    f"n AS (SELECT *, {_MINMAX.format(c='zs')} AS norm FROM z WINDOW w AS (PARTITION BY ranker, query_id))",
    "rank_rrf": "n AS (SELECT *, 1 / (60.0::DOUBLE + rank) AS norm FROM u)",
}
_WEIGHTS = {"bm25": 0.6, "tfidf": 0.4}
_WSUM = "SELECT query_id, doc_id, sum(CASE WHEN ranker = 'bm25' THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END * norm) AS s FROM n GROUP BY ALL"


def _fusion(method):
    def run(spark, sf):
        return X.fuse(X.normalize(_self_runs(spark, sf), method), _WEIGHTS, K)

    QUERIES[f"fusion_{method}"] = run
    ORACLE[f"fusion_{method}"] = "WITH" + _SELF_RUNS + f", {_UNION}, {_NORM[method]}," + S.ranked("run", _WSUM, K) + f" SELECT {RUN_COLS} FROM run"


for _m in _NORM:
    _fusion(_m)

_SWEEP = [(i, r, w) for i in range(11) for r, w in (("bm25", i / 10), ("tfidf", 1 - i / 10))]


@query(
    "WITH" + _SELF_RUNS + f", {_UNION}, {_NORM['minmax']}, cfg(config, ranker, w) AS (VALUES "
    + ", ".join(f"({i}, '{r}', {w!r}::DOUBLE)" for i, r, w in _SWEEP) + "),"
    + S.ranked("run", "SELECT config, query_id, doc_id, sum(w * norm) AS s FROM n JOIN cfg USING (ranker) GROUP BY ALL", 1, "config, query_id")
    + " SELECT config, round(count(*) FILTER (query_id = doc_id) / (SELECT count(*) FROM documents WHERE doc_id % 50 = 0)::DOUBLE, 6) AS acc1 FROM run GROUP BY config"
)
def fusion_sweep(spark, sf):
    gold = docs(spark, sf).where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "doc_id")
    return X.sweep(X.normalize(_self_runs(spark, sf), "minmax"), _SWEEP, gold, gold.count())


_NUMS = "list_distinct(regexp_extract_all(d.text, '[0-9]+'))"


def _numbers(spark, sf):
    return docs(spark, sf).select("doc_id", F.array_distinct(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))).alias("nums"))


@query(
    "WITH" + S.bm25("run", S.SELF, 20)
    + f", nums AS (SELECT doc_id, {_NUMS} AS nums FROM documents d), x AS (SELECT query_id, doc_id, q.nums AS qn, d.nums AS dn FROM run JOIN nums d USING (doc_id) JOIN nums q ON q.doc_id = query_id)"
    " SELECT query_id, doc_id, round(CASE WHEN len(qn) = 0 THEN 0.0::DOUBLE ELSE 0.2::DOUBLE * (len(list_intersect(qn, dn)) = len(qn))::INTEGER + 0.1::DOUBLE * len(list_intersect(qn, dn)) / len(qn) END, 6) AS bonus FROM x"
)
def numeric_bonus(spark, sf):
    n = _numbers(spark, sf)
    run = bm25_self(spark, sf, 20).select("query_id", "doc_id").join(n, "doc_id")
    run = run.join(n.select(F.col("doc_id").alias("query_id"), F.col("nums").alias("qnums")), "query_id")
    return run.select("query_id", "doc_id", F.round(X.numeric_bonus("qnums", "nums", 0.2, 0.1), 6).alias("bonus"))


_JAC = "CASE WHEN len(list_distinct(list_concat({a}, {b}))) = 0 THEN 0 ELSE len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b})))::DOUBLE END"


@query(
    "WITH" + S.bm25("run", S.SELF, 20)
    + f""", nums AS (SELECT doc_id, {_NUMS} AS nums, [lang] AS vals FROM documents d),
x AS (SELECT query_id, doc_id, rank, round(score + {_JAC.format(a='q.nums', b='d.nums')} + 0.5::DOUBLE * {_JAC.format(a='q.vals', b='d.vals')}, 6) AS adjusted
    FROM run JOIN nums d USING (doc_id) JOIN nums q ON q.doc_id = query_id)
SELECT query_id, doc_id, adjusted, CAST(row_number() OVER (PARTITION BY query_id ORDER BY adjusted DESC, rank) AS INTEGER) AS rank FROM x"""
)
def rerank_tiebreak(spark, sf):
    n = _numbers(spark, sf).join(docs(spark, sf).select("doc_id", F.array("lang").alias("vals")), "doc_id")
    run = bm25_self(spark, sf, 20)
    q = n.select(F.col("doc_id").alias("query_id"), F.col("nums").alias("q_numbers"), F.col("vals").alias("q_values"))
    f = run.select("query_id", "doc_id").join(n, "doc_id").join(q, "query_id").withColumnsRenamed({"nums": "d_numbers", "vals": "d_values"})
    return X.tiebreak(run, f)


_PAIR = (
    "ps AS (SELECT query_id, doc_id, rank, score, len(list_intersect(list_distinct(q.tokens), list_distinct(d.tokens))) "
    f"/ greatest(1, len(list_distinct(q.tokens)))::DOUBLE AS pair_score FROM run JOIN ({S.SELF}) q USING (query_id) JOIN p_d d USING (doc_id))"
)


def _pair_scores(spark, sf, run):
    q = self_queries(spark, sf)
    d = docs(spark, sf).select("doc_id", T.index_tokens("text").alias("dt"))
    rows = run.select("query_id", "doc_id").join(q, "query_id").join(d, "doc_id")
    return rows.select("query_id", "doc_id", M.pair_score(F.array_join("tokens", " "), F.array_join("dt", " ")).alias("pair_score"))


@query("WITH" + S.bm25("run", S.SELF, 20) + f", {_PAIR}," + S.ranked("o", "SELECT query_id, doc_id, pair_score AS s FROM ps WHERE rank <= 10", 10) + f" SELECT {RUN_COLS} FROM o")
def rerank_replace(spark, sf):
    run = bm25_self(spark, sf, 20)
    return X.rerank(run, _pair_scores(spark, sf, run), 10)


@query("WITH" + S.bm25("run", S.SELF, 20) + f", {_PAIR}," + S.ranked("o", "SELECT query_id, doc_id, 0.6::DOUBLE * pair_score + 0.4::DOUBLE * score AS s FROM ps", 20) + f" SELECT {RUN_COLS} FROM o")
def rerank_blend(spark, sf):
    run = bm25_self(spark, sf, 20)
    return X.rerank(run, _pair_scores(spark, sf, run), 20, 0.6)


def _feedback_sql(mu: bool) -> str:
    p = "(f.tf + 2000.0 * cf / tokens) / (all_tf + 2000.0)" if mu else "f.tf / all_tf::DOUBLE"
    return (
        "WITH" + S.bm25("run", S.SELF, K)
        + f""", seen AS (SELECT query_id, term, tf FROM run JOIN p_tf USING (doc_id) WHERE rank <= 5),
f AS (SELECT query_id, term, sum(tf) AS tf FROM seen GROUP BY ALL HAVING NOT regexp_full_match(term, '[0-9]')),
t AS (SELECT query_id, sum(tf) AS all_tf FROM seen GROUP BY ALL), c AS (SELECT term, sum(tf) AS cf FROM p_tf GROUP BY term), z AS (SELECT sum(tf) AS tokens FROM p_tf),
x AS (SELECT query_id, term, round(CAST({p} AS DOUBLE), 9) AS p FROM f JOIN t USING (query_id) JOIN c USING (term) CROSS JOIN z)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY p DESC, term) AS INTEGER) AS rank FROM x) WHERE rank <= 20"""
    )


def _feedback(spark, sf, mu):
    return X.feedback(bm25_self(spark, sf), R.postings(docs(spark, sf), R.analyzer("word")), 5, 20, mu)


@query(_feedback_sql(True))
def prf_rm3(spark, sf):
    return _feedback(spark, sf, 2000.0)


@query(_feedback_sql(False))
def prf_rocchio(spark, sf):
    return _feedback(spark, sf, None)


@query()
def prf_run(spark, sf):
    """Second pass with the expanded queries."""
    qterms = R.query_terms(self_queries(spark, sf), F.col("tokens"), "query_id")
    mixed = X.mixed_terms(qterms, _feedback(spark, sf, 2000.0), 0.5)
    d = docs(spark, sf)
    weights = R.bm25_weights(R.postings(d, R.analyzer("word")), R.collection(d, R.analyzer("word")), mixed)
    return R.top_k(R.bm25_scores(mixed, weights), K).select("query_id", "doc_id", "rank", "score")


@query("WITH" + S.bm25("run", f"SELECT b.item_id AS query_id, list_concat({S.tokens('b.text')}, {S.tokens('d.text')}) AS tokens FROM benchmark b JOIN documents d ON d.doc_id = b.item_id", K) + f" SELECT {RUN_COLS} FROM run")
def hyde_concat(spark, sf):
    """The document of the same number stands for a generated text."""
    gen = docs(spark, sf).select(F.col("doc_id").alias("item_id"), T.index_tokens("text").alias("gen"))
    q = bench(spark, sf).join(gen, "item_id").select("item_id", F.concat(T.index_tokens("text"), F.col("gen")).alias("tokens"))
    return R.bm25(docs(spark, sf), q, R.analyzer("word"), F.col("tokens"), "item_id", K)


@query("WITH" + S.bm25("run", S.SELF, K) + " SELECT query_id, max(CASE WHEN query_id = doc_id THEN rank END) AS gold_rank, max(CASE WHEN query_id = doc_id THEN score END) AS gold_score, max(score) AS top_score FROM run GROUP BY query_id")
def self_retrieval(spark, sf):
    own = F.col("query_id") == F.col("doc_id")
    return bm25_self(spark, sf).groupBy("query_id").agg(
        F.max(F.when(own, F.col("rank"))).alias("gold_rank"), F.max(F.when(own, F.col("score"))).alias("gold_score"), F.max("score").alias("top_score")
    )


# Catalogue items: p_name is the template, brand, type and size its axes.
AXES = {"brand": "p_brand", "type": "p_type", "size": "p_size"}


def part_tokens(spark, sf):
    p = B.spread(table(spark, sf, "part").select("p_partkey", "p_name", *AXES.values()))
    params = F.array(*(T.param_token(F.lit(a), F.col(c).cast("string")) for a, c in AXES.items()))
    return p.select(F.col("p_partkey").alias("doc_id"), F.concat(T.index_tokens("p_name"), params).alias("tokens"), params.alias("params"), F.col("p_name").alias("name"))


_SLUG = "array_to_string(regexp_extract_all(lower({c}), '[a-záéíóúüñ0-9]+'), '_')"
_PARAMS = "[" + ", ".join(f"'param_{a}_' || {_SLUG.format(c=f'CAST({c} AS VARCHAR)')}" for a, c in AXES.items()) + "]"
_PART = f"SELECT p_partkey AS doc_id, list_concat({S.tokens('p_name')}, {_PARAMS}) AS tokens FROM part"


@query("WITH" + S.bm25("run", _PART.replace("AS doc_id", "AS query_id") + " WHERE p_partkey % 50 = 0", K, k1=0.6, b=0.35, docs=_PART) + f" SELECT {RUN_COLS} FROM run")
def bm25_params_topk(spark, sf):
    p = part_tokens(spark, sf)
    q = p.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("tokens").alias("tokens"))
    return R.bm25(p, q, F.col("tokens"), F.col("tokens"), "query_id", K, 0.6, 0.35)


_FORMS = "SELECT p_partkey * 10 + f AS query_id, CASE f WHEN 0 THEN {t} WHEN 1 THEN {p} ELSE list_concat({t}, {p}) END AS tokens FROM part, range(0, 3) r(f) WHERE p_partkey % 50 = 0"


@query("WITH" + S.bm25("run", _FORMS.format(t=S.tokens("p_name"), p=_PARAMS), K, docs=_PART) + f" SELECT {RUN_COLS} FROM run")
def param_formulations(spark, sf):
    """Text only, signature only, and both: one job for all formulations of a query."""
    p = part_tokens(spark, sf)
    forms = F.array(T.index_tokens("name"), F.col("params"), F.col("tokens"))
    q = p.where("doc_id % 50 = 0").select("doc_id", F.posexplode(forms).alias("f", "qtokens"))
    q = q.select((F.col("doc_id") * 10 + F.col("f")).alias("query_id"), F.col("qtokens"))
    return R.bm25(p, q, F.col("tokens"), F.col("qtokens"), "query_id", K)


@query()
def tfidf_phrases_replace_topk(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), T.phrases_replace(T.index_tokens("p_name"), T.sort_phrases(F.array(F.array_join(T.index_tokens("p_name"), "_")))).alias("tokens"))
    q = p.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("tokens"))
    return R.tfidf(p, q, F.col("tokens"), F.col("tokens"), "query_id", K)


_ADD = f"SELECT p_partkey AS doc_id, list_append({S.tokens('p_name')}, array_to_string({S.tokens('p_name')}, '_')) AS tokens FROM part"


@query("WITH" + S.postings("p", _ADD) + "," + S.tfidf("run", _ADD.replace("AS doc_id", "AS query_id") + " WHERE p_partkey % 50 = 0", K) + f" SELECT {RUN_COLS} FROM run")
def tfidf_phrases_add_topk(spark, sf):
    tokens = T.phrases_add(T.index_tokens("p_name"), F.array(F.array_join(T.index_tokens("p_name"), "_")))
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), tokens.alias("tokens"))
    q = p.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("tokens"))
    return R.tfidf(p, q, F.col("tokens"), F.col("tokens"), "query_id", K)


@query()
def encoder_topk(spark, sf):
    """Dense search with the pluggable encoder (its deterministic stand-in)."""
    d = docs(spark, sf).select("doc_id", M.encode("text").alias("vec"))
    q = bench(spark, sf).select(F.col("item_id").alias("query_id"), M.encode("text").alias("qvec"))
    return R.dense(d, q, K)
