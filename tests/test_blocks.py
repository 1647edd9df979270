"""Block products give what joins of postings give, and shuffle no row for a pair."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomrank.functions import text as T
from loomrank.operators import audit as A
from loomrank.operators import blocks as B
from loomrank.operators import retrieval as R
from loomrank.plans import report_queries


def test_blocks_equal_joins(spark, monkeypatch):
    """Several passes, blocks and cells, equal queries, null texts and text ids against the joined scores."""
    for name, value in (("PASS_TERMS", 150), ("DENSE", 3), ("DOCS", 16), ("QUERIES", 2)):
        monkeypatch.setattr(B, name, value)
    text = lambda i: " ".join(f"w{(i * j) % 23 + j % 3}" for j in range(i % 17)) + f" id{i}"
    rows = [(f"d{i}", text(i) if i != 5 else None) for i in range(90)] + [("copy", text(40))]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    q = docs.where("doc_id in ('d12', 'd40', 'd33', 'd61', 'copy')").withColumnRenamed("doc_id", "query_id")
    words = T.index_tokens("text")
    weights = R.bm25_weights(R.postings(docs, words), R.collection(docs, words), k1=0.9, b=0.4)
    want = R.top_k(R.bm25_scores(R.query_terms(q, words, "query_id"), weights), 7).select("query_id", "doc_id", "rank", "score")
    got = R.bm25_grid(docs, q, words, words, "query_id", 7, [(1.2, 0.75), (0.9, 0.4)]).where("k1 = 0.9").select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    for least in (1, 2):
        a, b = (sorted(map(tuple, f(docs, q, words, words, "query_id", 7, least).collect())) for f in (R.tfidf, R._tfidf_joined))
        assert [x[:3] for x in a] == [x[:3] for x in b] and [x[3] for x in a] == pytest.approx([x[3] for x in b], abs=2e-6)


def test_no_row_for_a_pair(spark):
    """The plan of a run has one exchange of k rows a query and task, and no join of postings."""
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.lit("one two").alias("text"))
    run = R.bm25(docs, docs.withColumnRenamed("doc_id", "q"), T.index_tokens("text"), T.index_tokens("text"), "q", 3)
    assert "Join" not in run._jdf.queryExecution().optimizedPlan().toString() and run.count() == 180


def test_signatures_round_to_four_places(spark):
    """Vectors that differ in the fifth place only share a signature, as in the SQL."""
    w = spark.createDataFrame([(1, "a", 0.500012), (2, "a", 0.500031), (3, "a", 0.5002)], "doc_id long, term string, weight double")
    s = {r["doc_id"]: r["signature"] for r in A.vector_signatures(w).collect()}
    assert s[1] == s[2] != s[3]


def test_runs_move_only_the_best(spark):
    """Documents in as many parts as cores are not dealt out again, and equal queries send one row group a task."""
    n = spark.sparkContext.defaultParallelism
    docs = spark.range(0, 640, 1, n).select(F.col("id").alias("doc_id"), F.concat(F.lit("one two w"), F.col("id") % 7).alias("text"))
    words = T.index_tokens("text")
    run = R.bm25(docs, docs.withColumnRenamed("doc_id", "q"), words, words, "q", 3)
    plan = run._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Repartition \d+, true", plan) and "Window" not in plan
    rows = {r["query_id"]: r["doc_id"] for r in run.where("rank = 1").collect()}
    assert rows == {i: i % 7 for i in range(640)}


def test_both_runs_from_one_search(spark):
    """The runs of BM25 and TF-IDF of one search are those of a search each."""
    text = lambda i: " ".join(f"w{(i * j) % 23 + j % 3}" for j in range(i % 17)) + f" id{i}"
    docs = spark.createDataFrame([(i, text(i) if i != 5 else None) for i in range(90)] + [(None, text(40))], "doc_id int, text string")
    args = docs, docs.where("doc_id % 9 = 4").withColumnRenamed("doc_id", "query_id"), T.index_tokens("text"), T.index_tokens("text"), "query_id", 7
    both = R.bm25_tfidf(*args)
    for name, alone in (("bm25", R.bm25(*args)), ("tfidf", R.tfidf(*args))):
        assert sorted(map(str, both.where(F.col("ranker") == name).select(*alone.columns).collect())) == sorted(map(str, alone.collect()))


def test_character_terms_of_words(spark, monkeypatch):
    """Terms made of words within a task are those of the column, in counts and in the run; no row for a term of a document."""
    monkeypatch.setattr(B, "SLICE", 7)
    rows = [(i, " ".join(f"wört{(i * j) % 11}s" for j in range(i % 9)) + f"\tx{i} 😀é" if i % 13 else None) for i in range(40)]
    docs = spark.createDataFrame([*rows, (90, "")], "doc_id long, text string")
    parts = T.char_words("text"), T.char_windows
    want, got = B.doc_freq(docs, T.char_wb("text")), B.doc_freq_of_parts(docs, *parts)
    assert {(r.term, r.df) for r in got.collect()} == {(r.term, r.df) for r in want.collect()}
    q = docs.where("doc_id % 7 = 1").withColumnRenamed("doc_id", "query_id")
    for least in (1, 2):
        a = R.tfidf(docs, q, T.char_wb("text"), T.char_wb("text"), "query_id", 5, least)
        b = R.tfidf(docs, q, T.char_wb("text"), T.char_wb("text"), "query_id", 5, least, parts)
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and a.count()


CELLS = [(k1, b) for k1 in (0.6, 1.2, 1.5) for b in (0.25, 0.75, 0.9)]


def _own_text(i):
    common = " ".join(f"w{(i * j) % 23 + j % 3}" for j in range(1 + (i * i) % 29))
    return f"{common} {' '.join(f'id{i // 2}' for _ in range(1 + i % 3))} {'' if i % 4 else f'only{i} only{i}'}"


def test_own_documents_bound_the_search(spark):
    """Queries that are documents: the best of every setting as without bounds; copies, short texts, null texts and an id of two texts too."""
    rows = [(i, _own_text(i)) for i in range(120)] + [(200 + i, _own_text(3 * i)) for i in range(20)] + [(6, "w1 w2 twice"), (9, None), (300, None), (301, "w1"), (302, "w1 w1 w1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id")
    q, words = docs.where("doc_id % 3 = 0 or doc_id > 199").withColumnRenamed("doc_id", "query_id"), T.index_tokens("text")
    want, got = (R.bm25_grid(docs, q, words, words, "query_id", 1, CELLS, **x).collect() for x in ({}, {"own": True}))
    assert len(want) == 62 * len(CELLS) and sorted(map(tuple, got)) == sorted(map(tuple, want))


def _own_side(texts, own):
    """Documents, and those of ``own`` as queries with their counts."""
    counts = [Counter(x) for x in texts]
    df = Counter(t for c in counts for t in c)
    terms = sorted(df, key=lambda t: (-df[t], t))
    place = {t: i for i, t in enumerate(terms)}
    entries = [sorted((place[t], n) for t, n in counts[i].items()) for i in own]
    term, qtf = (np.array([e[k] for x in entries for e in x]) for k in (0, 1))
    start, avgdl = np.cumsum([0, *map(len, entries)]), float(np.mean([len(x) for x in texts]))
    side = B.Side(pa.array(terms), np.array([df[t] for t in terms]), len(texts), np.array(own), np.arange(len(own)), start, term, qtf.astype(float), cells=CELLS, avgdl=avgdl)
    side.weight = side.idf(side.df)[term] ** 2
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "tokens"]), side, qtf.astype(float)


@pytest.mark.parametrize("skip, many, apart", [(0.5, 0.04, 7), (0.0, 1.0, 400), (0.9, 1.0, 7), (0.5, -1.0, 7)])
def test_bounds_in_small_blocks(monkeypatch, skip, many, apart):
    """With pieces of every size, frequent terms left out or not, and unknown floors."""
    for name, value in (("DENSE", 3), ("DOCS", 16), ("QUERIES", 4), ("SLICE", 40), ("SKIP", skip), ("MANY", many), ("HITS", 50)):
        monkeypatch.setattr(B, name, value)
    docs, side, qtf = _own_side([_own_text(i).split() for i in range(120)] + [["w1"], ["w1"] * 9], [*range(0, 120, 3), 120, 121])
    want = B._scan(iter([docs]), side, 1)
    side.set_floor(qtf, side.ids[::apart][1:])
    for a, b in zip(want, B._scan(iter([docs]), side, 1), strict=True):
        assert a.id.tolist() == b.id.tolist() and np.abs(a.score - b.score).max() < 2e-6


def test_settings_are_not_multiplied_for_pairs_out_of_reach(monkeypatch):
    """No matrix of all settings for documents that are not near a query's own."""
    rng = np.random.default_rng(3)
    texts = [[*(f"w{x}" for x in rng.integers(0, 40, 30)), *(f"r{x}" for x in rng.integers(0, 5000, 8))] for _ in range(400)]
    docs, side, qtf = _own_side(texts, range(0, 400, 10))
    want = B._scan(iter([docs]), side, 1)
    side.set_floor(qtf, np.array([], np.int64))
    monkeypatch.setattr(B, "_products", None)
    for a, b in zip(want, B._scan(iter([docs]), side, 1), strict=True):
        assert a.id.tolist() == b.id.tolist() and np.abs(a.score - b.score).max() < 2e-6


def test_family_best_bounds_its_search(spark, monkeypatch):
    """Each query starts with the score of its own document, under every setting."""
    seen, plain = [], B.Side.set_floor
    monkeypatch.setattr(B.Side, "set_floor", lambda self, *args: (plain(self, *args), seen.append(self.floor)))
    best = report_queries.family_best(spark, "/root/testdata/sf0.001").collect()
    assert len(best) == 5 and len(seen) == 1 and len(seen[0]) == 25 and (seen[0] > 0).all()
