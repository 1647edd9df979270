"""Hand-computed values."""

import math

import pytest
from pyspark.sql import functions as F

from loomrank.functions import text as T
from loomrank.operators import audit as A
from loomrank.operators import evaluation as E
from loomrank.operators import fusion as X
from loomrank.operators import retrieval as R
from loomrank.operators import structured as C
from loomrank.sources import io


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_text(spark):
    assert one(spark, T.normalize_text(F.lit("Tubo 1.234,50 m AL 95%"))) == "tubo 1234.50 m al 95 %"
    assert one(spark, T.extract_numbers(F.lit("4x40 y 1.60"))) == [4.0, 40.0, 1.6]
    token = T.param_token(F.lit("banda de mantenimiento"), F.lit("i ≥ 5 horas"))
    assert one(spark, token) == "param_banda_de_mantenimiento_i_ge_5_horas"
    assert T.replace_phrases(["a", "b", "c"], ["a_b", "z_w"]) == ["a_b", "c", "z_w"]
    assert one(spark, T.banda_normalize(F.lit("i<==3 horas"))) == "i <= 3 horas"
    assert one(spark, T.json_repair(F.lit('```json\n{"a": "1",}\n```')))["a"] == "1"
    grams = one(spark, T.char_wb(F.lit("ab tubo")))
    assert sorted(grams) == sorted([" ab", "ab ", " ab ", " tu", "tub", "ubo", "bo ", " tub", "tubo", "ubo ", " tubo", "tubo "])


def test_bm25_squares_idf(spark):
    docs = spark.createDataFrame([(1, "red"), (2, "blue"), (3, "green")], "doc_id long, text string")
    queries = spark.createDataFrame([(7, "red red")], "q long, text string")
    run = R.bm25(docs, queries, T.index_tokens("text"), T.index_tokens("text"), "q", 5).collect()
    assert [(r["doc_id"], r["score"]) for r in run] == [(1, round(math.log(2.5 / 1.5 + 1) ** 2, 6))]


def test_fusion_and_rerank(spark):
    runs = spark.createDataFrame([("a", 1, 5, 1, 2.0), ("b", 1, 5, 2, 2.0)], "ranker string, query_id int, doc_id int, rank int, score double")
    assert X.rrf(runs, {"a": 1.0, "b": 1.5}, 5).first()["score"] == pytest.approx(1 / 60 + 1.5 / 61, abs=1e-6)
    assert {r["norm"] for r in X.normalize(runs, "minmax").collect()} == {0.0}
    bonus = X.numeric_bonus(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3)), 1.0, 1.0)
    assert one(spark, bonus) == 0.5
    empty = F.array().cast("array<string>")
    assert one(spark, T.jaccard(empty, empty)) == 0.0


def test_statistics(spark):
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "name string, p double")
    assert {r["name"]: r["p_holm"] for r in E.holm(p).collect()} == {"a": 0.03, "b": 0.06, "c": 0.06}
    rows = spark.createDataFrame([(i, float(i), float(i * i)) for i in range(5)], "k int, a double, b double")
    assert E.spearman(rows, "a", "b", "k").first()["rho"] == 1.0


def test_ndcg_of_parent(spark):
    s = spark.createDataFrame([(1, 1, "p", None, 2, 0.0, 1 / math.log2(3))], "query_id int, gold_id int, gold_parent string, first_item int, first_parent int, dcg_item double, dcg_parent double")
    siblings = spark.createDataFrame([("p", 3)], "gold_parent string, n int")
    got = {r["target"]: r["ndcg"] for r in E.stacked(s, siblings).collect()}
    assert got["parent"] == pytest.approx(0.296082, abs=1e-6)


def test_lookup_and_bio(spark):
    facts = spark.createDataFrame([(i, "t", a, v) for i, x, y in ((1, "r", "s"), (2, "r", "l"), (3, "b", "s")) for a, v in (("col", x), ("size", y))], "item int, parent string, axis string, value string")
    asked = spark.createDataFrame(
        [(1, "t", "col", "r"), (1, "t", "size", "s"), (2, "t", "col", "r"), (3, "t", "col", None), (4, "u", "col", "r"), (5, "t", "col", "none")],
        "query_id int, parent string, axis string, value string",
    )
    n = {r["query_id"]: r["count"] for r in C.catalog_lookup(facts, asked).groupBy("query_id").count().collect()}
    assert n == {1: 1, 2: 2, 3: 3, 5: 3}
    tags = spark.createDataFrame([(1, i, t) for i, t in enumerate("O B-X I-X I-Y O".split())], "seq_id int, pos int, tag string")
    assert {tuple(r) for r in C.bio_spans(tags).select("axis", "start", "stop").collect()} == {("X", 1, 2), ("Y", 3, 3)}


def test_run_round_trip(spark, tmp_path):
    run = spark.createDataFrame([("1", "9", 1, 2.5), ("1", "8", 2, 1.5)], "query_id string, doc_id string, rank int, score double")
    io.write_run(run, str(tmp_path / "run"))
    assert sorted(map(tuple, io.read_run(spark, str(tmp_path / "run")).collect())) == sorted(map(tuple, run.collect()))


def test_docs_of_both_shapes(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": "1", "text": "x", "item_key": "top", "metadata": {"item_key": "meta"}}]')
    (tmp_path / "b.json").write_text('{"documents": [{"id_": "2", "content": "y"}]}')
    assert io.read_docs(spark, str(tmp_path / "a.json")).select("id", "item_key", "text").collect() == [("1", "meta", "x")]
    assert io.read_docs(spark, str(tmp_path / "b.json")).select("id", "item_key", "text").collect() == [("2", None, "y")]


def test_maxsim_preselects_256(spark):
    """The ten best by MaxSim of the 256 nearest centroids, by brute force."""
    import numpy as np

    from loomrank.plans import retrieval_queries

    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float).reshape(-1, 4, 16)
    mid = x.mean(axis=1)
    mid /= np.linalg.norm(mid, axis=1, keepdims=True)
    got = {}
    for r in retrieval_queries.maxsim_topk(spark, sf).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["score"]
    for q in np.flatnonzero(ids % 50 == 0):
        near = np.argsort(-(mid @ mid[q]), kind="stable")[:256]
        best = np.sort(np.einsum("qd,ntd->nqt", x[q], x[near]).max(axis=2).sum(axis=1))[::-1][:10]
        assert [got[ids[q]][i + 1] for i in range(10)] == pytest.approx(best.tolist(), abs=2e-5)


def test_errors_and_edges(spark, tmp_path):
    runs = spark.createDataFrame([("a", 1, 5, 1, 2.0), ("c", 1, 6, 2, 2.0)], "ranker string, query_id int, doc_id int, rank int, score double")
    with pytest.raises(Exception, match="no weight for ranker c"):
        X.rrf(runs, {"a": 1.0}, 5).collect()
    assert one(spark, T.formula_to_sql(F.lit("$x ^ 2 > 9"))) == "power(x, 2) > 9"
    v = spark.createDataFrame([(1, [[1.0, 0.0]]), (2, []), (3, [[0.0, 2.0], [2.0, 0.0]])], "doc_id long, tokens array<array<double>>")
    q = spark.createDataFrame([(7, [[1.0, 0.0], [0.0, 1.0]])], "query_id long, tokens array<array<double>>")
    assert {r["doc_id"]: r["score"] for r in R.maxsim(v, q, 5, 5, 2).collect()} == {1: 1.0, 2: 0.0, 3: 4.0}
    with pytest.raises(ValueError, match="more than 2 rows"):
        io.markdown_table(spark.range(3), 2)
    d = spark.createDataFrame([("p", x) for x in (0.5, 0.5, -0.25, 0.75, 0.1)], "pair string, d double")
    r = E.bootstrap(d, 2000).first()
    assert r["diff"] == pytest.approx(0.32) and r["ci_low"] < 0.32 < r["ci_high"] and 0 < r["one_sided"] < 0.2


def test_query_stream(spark, tmp_path):
    """A stream of queries gives the run of the same queries as a table."""
    from loomrank.streaming import search

    docs = spark.createDataFrame([(1, "red apple"), (2, "blue sky"), (3, "red sky at night")], "doc_id long, text string")
    queries = spark.createDataFrame([(7, "red sky"), (8, "apple")], "query_id long, text string")
    queries.write.parquet(str(tmp_path / "queries"))
    words = T.index_tokens("text")
    weights = R.bm25_weights(R.postings(docs, words), R.collection(docs, words))
    got = []
    stream = spark.readStream.schema(queries.schema).parquet(str(tmp_path / "queries"))
    search.bm25_stream(stream, weights, words, 5, lambda df, _: got.extend(df.collect())).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(map(tuple, got)) == sorted(map(tuple, R.bm25(docs, queries, words, words, "query_id", 5).collect()))


def test_error_types_compare_whole_texts(spark):
    """Kinds by brute force on the smallest documents."""
    import difflib
    import re
    from collections import Counter

    from loomrank.plans import analytics_queries as Q

    sf = "/root/testdata/sf0.001"
    text = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    norm = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", T.normalize_text("text")).collect()}
    numbers = lambda t: re.findall(r"[0-9]+(?:[.,][0-9]+)?", t)
    want = Counter()
    for r in Q.bm25_self(spark, sf, Q.K).where("rank <= 2 and doc_id != query_id").collect():
        q, d = r["query_id"], r["doc_id"]
        a, b = numbers(text[q]), numbers(text[d])
        if a and b and a != b:
            want["numeric mismatch"] += 1
        elif text[q] == text[d]:
            want["near-duplicate"] += 1
        else:
            want["lexical confusion" if difflib.SequenceMatcher(None, norm[q], norm[d]).ratio() > 0.7 else "ranking failure"] += 1
    assert {r["kind"]: r["n"] for r in Q.error_types(spark, sf).collect()} == dict(want)


def test_parameters_are_normalised(spark):
    raw = '{"A": {"label": " TERRENO ", "values": [{"label": "a", "value": " Volumen  Escaso "}, {"label": "b", "value": "blando"}]}, "B": {"label": "b", "values": [{"label": "c", "value": "volumen escaso"}, {"label": "d", "value": "10 x"}]}}'
    got = one(spark, T.normalize_parameters(F.from_json(F.lit(raw), io.VALUES)))
    assert got["multi"] == ["volumen escaso"]
    assert got["norm"]["A"]["label_norm"] == "terreno" and got["norm"]["B"]["values"][1]["value_norm"] == "10 x"
    empty = one(spark, T.normalize_parameters(F.lit(None).cast(io.VALUES)))
    assert empty["norm"] == {} and empty["multi"] == []
    assert one(spark, T.numeric_equal(F.lit("3,50 m"), F.lit("3.5"))) and not one(spark, T.numeric_equal(F.lit("m"), F.lit("m")))


def test_validated_joins_and_sets(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "k int, a string")
    b = spark.createDataFrame([(1, "p"), (3, "q"), (None, "r"), (None, "s")], "k int, b string")
    assert [tuple(r) for r in A.one_to_one(a, b, "k").collect()] == [(1, "x", "p")]
    with pytest.raises(Exception, match="not unique on the right"):
        A.one_to_one(a, b.union(b), "k").collect()
    assert {r[0] for r in A.intersect_strict(a.where("k > 0"), a.where("k > 0"), "k").collect()} == {1, 2}
    with pytest.raises(Exception, match="differ in k"):
        A.intersect_strict(a.where("k > 0"), b.where("k > 0"), "k").collect()
    assert [r["a"] for r in A.sample_rows(a, a.where("k = 2"), "k").collect()] == ["y"]
    with pytest.raises(KeyError):
        A.sample_rows(a, b.where("k = 3"), "k")
    assert A.exact_matches(spark.createDataFrame([(0.9,), (0.91,), (None,)], "score double")).count() == 1


def test_method_reports(spark):
    acc = spark.createDataFrame([("a", 0.5), ("b", 0.75), ("c", 0.75), ("d", 0.1)], "method string, acc1 double")
    rows = [("b", "a", 0.25, 0.1, 0.4, 0.01, 0.02, 0.01), ("c", "b", 0.0, -0.1, 0.2, 0.9, 0.9, 0.9)]
    pairs = spark.createDataFrame(rows, "m1 string, m2 string, delta double, ci_low double, ci_high double, p_raw double, p_holm double, p_bh double")
    got = {r["method"]: r for r in E.against_best(acc, pairs).collect()}
    assert got["b"]["delta"] == 0.0 and got["b"]["sig_holm"] and got["a"]["delta"] == 0.25 and got["a"]["sig_bh"]
    assert (got["c"]["ci_low"], got["c"]["ci_high"], got["c"]["sig_holm"]) == (-0.2, 0.1, False)
    assert got["d"]["delta"] is None and not got["d"]["sig_holm"]
    best = E.family_best(acc.withColumn("f", F.when(F.col("method") == "a", "x").otherwise("y")), "f").collect()
    assert {(r["family"], r["method"]) for r in best} == {("x", "a"), ("y", "b")}
    times = spark.createDataFrame([("a", float(i)) for i in range(101)] + [("z", 1.0)], "method string, ms double")
    assert [tuple(r) for r in E.latency_accuracy(times, acc).collect()] == [("a", 50.0, 95.0, 0.5)]


def test_mapping_runs_and_features(spark, tmp_path):
    (tmp_path / "good.jsonl").write_text('{"doc_id": 1, "external_id": "b"}\n{"doc_id": 0, "external_id": "a"}\n')
    (tmp_path / "bad.jsonl").write_text('{"doc_id": 0, "external_id": "b"}\n{"doc_id": 2, "external_id": "a"}\n')
    assert io.read_mapping(spark, f"{tmp_path}/good.jsonl").count() == 2
    with pytest.raises(ValueError, match="0 to 1"):
        io.read_mapping(spark, f"{tmp_path}/bad.jsonl")
    for method in ("bm25_k1_1.20", "bm25_other", "dense_a", "bge_b", "tfidf"):
        (tmp_path / "runs" / method).mkdir(parents=True)
        (tmp_path / "runs" / method / "metrics_dual.json").write_text("{}")
    (tmp_path / "runs" / "unfinished").mkdir()
    found = lambda mode: [r["method"] for r in io.discover_runs(spark, f"{tmp_path}/runs", mode, ("BM25_other",)).collect()]
    assert found("GLOBAL") == ["bge_b", "bm25_other", "dense_a", "tfidf"] and found("LEXICAL") == ["bm25_other", "tfidf"]
    assert found("DENSE") == ["bge_b", "dense_a"] and found("BM25_VARIANTS") == ["bm25_k1_1.20", "bm25_other"]
    rows = spark.createDataFrame([(1, "x,y"), (2, None)], "k int, t string")
    for fmt, read in (("parquet", spark.read.parquet), ("csv", spark.read.option("header", True).schema("k int, t string").csv), ("jsonl", spark.read.schema("k int, t string").json)):
        io.write_feats(rows, f"{tmp_path}/{fmt}", fmt)
        assert sorted(read(f"{tmp_path}/{fmt}").collect()) == sorted(rows.collect())
    with pytest.raises(ValueError):
        io.write_feats(rows, f"{tmp_path}/x", "xml")


def test_spans_labels_and_places(spark):
    spans = spark.createDataFrame([(1, "A", 0, 2), (1, "A", 3, 5), (1, "B", 5, 6), (1, "B", 0, 0), (1, "B", 8, 9)], "seq_id int, axis string, start int, stop int")
    texts = spark.createDataFrame([(1, "ab cdefg h")], "seq_id int, text string")
    assert {tuple(r) for r in C.merge_adjacent(spans, texts).collect()} == {(1, "A", 0, 5), (1, "B", 5, 6), (1, "B", 8, 9)}
    axes = spark.createDataFrame([("b ",), ("a",), ("b",)], "axis string")
    assert {r["label"]: r["id"] for r in C.bio_labels(axes).collect()} == {"O": 0, "B-a": 1, "B-b": 2, "I-a": 3, "I-b": 4}
    f1 = C.macro_f1(C.span_f1(spans, spans.where("axis = 'A'"))).first()
    assert (f1["axes"], f1["macro_f1"]) == (1, 1.0)
    gold = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (2, "a", "x")], "query_id int, axis string, value string")
    got = C.classifier_accuracy(gold.where("axis = 'a'"), gold).first()
    assert (got["axis_accuracy"], got["query_accuracy"]) == (0.666667, 0.5)
    assert C.classifier_accuracy(gold, gold.limit(0)).first()["query_accuracy"] == 0.0
    places = spark.createDataFrame([(1, 1), (2, 4), (3, None), (4, 11)], "query_id int, place int")
    got = E.single_match(places).first()
    assert (got["success"], got["mrr"], got["mean_place"], got["median_place"], got["perfect"]) == (0.5, 0.3125, 2.5, 2.5, 0.25)
    assert got["distribution"] == [0.25, 0, 0, 0.25, 0, 0, 0, 0, 0, 0]


def test_best_fused_run_is_exported(spark, tmp_path):
    rows = [("w1", 1, 5, 1, 2.0), ("w2", 1, 6, 1, 3.0), ("w2", 1, 7, 2, 1.0), ("w2", 1, 8, 3, 0.5)]
    fused = spark.createDataFrame(rows, "config string, query_id int, doc_id int, rank int, score double")
    metrics = spark.createDataFrame([("w1", 0.5), ("w2", 0.5), ("w0", 0.1)], "config string, acc1 double")
    assert io.export_best(spark, fused, metrics, f"{tmp_path}/a", 2) == "w1"
    assert io.export_best(spark, fused, metrics.where("config != 'w1'"), f"{tmp_path}/b", 2) == "w2"
    assert sorted(r["doc_id"] for r in io.read_run(spark, f"{tmp_path}/b").collect()) == ["6", "7"]
