"""SQL fragments of the oracle queries (DuckDB)."""

from __future__ import annotations

from loomrank.functions.text import ACCENTED, INDEX_TOKEN, PLAIN, STOP_WORDS


def tokens(c: str = "text") -> str:
    return f"regexp_extract_all(translate(lower({c}), '{ACCENTED}', '{PLAIN}'), '{INDEX_TOKEN}')"


def nostop(c: str = "text") -> str:
    words = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"coalesce((SELECT list(t ORDER BY i) FROM (SELECT unnest({tokens(c)}) AS t, generate_subscripts({tokens(c)}, 1) AS i) WHERE t NOT IN ({words})), [])"


DOCS = f"SELECT doc_id, {tokens()} AS tokens FROM documents"
BENCH = f"SELECT item_id AS query_id, {tokens()} AS tokens FROM benchmark"
SELF = f"SELECT doc_id AS query_id, {tokens()} AS tokens FROM documents WHERE doc_id % 50 = 0"


def postings(name: str, docs: str = DOCS) -> str:
    """CTEs <name>_d (doc_id, tokens), <name>_st (n, avgdl), <name>_tf (doc_id, dl, term, tf), <name>_df (term, df)."""
    p = name
    return f"""
{p}_d AS ({docs}),
{p}_st AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(tokens)) AS avgdl FROM {p}_d),
{p}_tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(tokens) AS dl, unnest(tokens) AS term FROM {p}_d) GROUP BY ALL),
{p}_df AS (SELECT term, count(*) AS df FROM {p}_tf GROUP BY term)"""


def ranked(name: str, scores: str, k: int, by: str = "query_id") -> str:
    """CTE <name> (by, doc_id, rank, score) from a select of (by, doc_id, s)."""
    return f"""
{name} AS (SELECT * FROM (
    SELECT {by}, doc_id, CAST(row_number() OVER (PARTITION BY {by} ORDER BY score DESC, doc_id) AS INTEGER) AS rank, score
    FROM (SELECT {by}, doc_id, round(s, 6) AS score FROM ({scores}))) WHERE rank <= {k})"""


def bm25(name: str, queries: str, k: int, k1: float = 1.2, b: float = 0.75, power: int = 2, post: str = "p", docs: str = DOCS, qterms: str | None = None) -> str:
    """CTEs with the run <name>; the postings CTEs are included."""
    idf = "ln((n - df + 0.5) / (df + 0.5) + 1)"
    part = f"tf * ({k1} + 1.0) / (tf + {k1} * (1.0 - {b}) + {k1} * {b} * dl / avgdl)"
    scores = f"""
    SELECT query_id, doc_id, sum({' * '.join([f'CAST({idf} AS DOUBLE)'] * power)} * CAST({part} AS DOUBLE)) AS s
    FROM {name}_qt JOIN {post}_tf USING (term) JOIN {post}_df USING (term) CROSS JOIN {post}_st GROUP BY query_id, doc_id"""
    qt = qterms or f"SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest(tokens) AS term FROM ({queries}))"
    return postings(post, docs) + f",\n{name}_qt AS ({qt})," + ranked(name, scores, k)


def tfidf(name: str, queries: str, k: int, post: str = "p", min_df: int = 1) -> str:
    """CTEs of the run <name>; the postings CTEs must precede."""
    idf = "(ln((1 + n) / (1 + df)) + 1)"
    scores = f"SELECT query_id, doc_id, sum(wq * w) AS s FROM {name}_q JOIN {name}_w USING (term) GROUP BY query_id, doc_id"
    return f"""
{name}_r AS (SELECT doc_id, term, tf * {idf} AS raw, {idf} AS idf FROM {post}_tf JOIN {post}_df USING (term) CROSS JOIN {post}_st WHERE df >= {min_df}),
{name}_w AS (SELECT doc_id, term, idf, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS w FROM {name}_r),
{name}_v AS (SELECT term, any_value(idf) AS idf FROM {name}_w GROUP BY term),
{name}_q AS (SELECT query_id, term, qtf * idf / sqrt(sum(qtf * idf * qtf * idf) OVER (PARTITION BY query_id)) AS wq
    FROM (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(tokens) AS term FROM ({queries})) GROUP BY ALL) JOIN {name}_v USING (term)),""" + ranked(name, scores, k)


JUDGED = """
gold AS (SELECT doc_id AS query_id, doc_id AS gold_id, source AS gold_parent FROM documents WHERE doc_id % 50 = 0),
cand AS (SELECT r.*, gold_id, gold_parent, source AS parent, r.doc_id = gold_id AS rel_item, coalesce(source = gold_parent, false) AS rel_parent
    FROM run r JOIN gold USING (query_id) LEFT JOIN documents d ON d.doc_id = r.doc_id),
summ AS (SELECT gold.*, f.first_item, f.first_parent, coalesce(dcg_item, 0) AS dcg_item, coalesce(dcg_parent, 0) AS dcg_parent FROM gold LEFT JOIN (
    SELECT query_id, min(rank) FILTER (rel_item) AS first_item, min(rank) FILTER (rel_parent) AS first_parent,
        sum(CASE WHEN rel_item AND rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg_item,
        sum(CASE WHEN rel_parent AND rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg_parent
    FROM cand GROUP BY query_id) f USING (query_id)),
sib AS (SELECT source AS gold_parent, count(*) AS n FROM documents GROUP BY source),
stk AS (SELECT query_id, gold_id, gold_parent, 'item' AS target, first_item AS first, dcg_item AS ndcg FROM summ
    UNION ALL SELECT query_id, gold_id, gold_parent, 'parent', first_parent,
        dcg_parent / (SELECT sum(1 / log2(i + 1)) FROM range(1, CAST(least(sib.n, 10) + 1 AS BIGINT)) t(i)) FROM summ JOIN sib USING (gold_parent))"""

METRICS = """count(*) AS queries, round(avg(CASE WHEN first <= 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS acc1, round(avg(CASE WHEN first <= 5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall5,
    round(avg(CASE WHEN first <= 10 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall10, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr"""
