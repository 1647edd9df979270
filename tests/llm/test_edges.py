"""Ids above 2^53 beside nulls, empty tables, clashing columns, repeated rows and the folds of the registered queries."""

import itertools
import math
import zlib

import numpy as np
import pytest

from loomrank.llm import covertree, decontaminate, hdlang, hpylm, htmltext, neardup, packing, secrets, tokencount, toxicity

BIG = 2**53 + 1
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, predicted int, h long, part int, group long, cell string, shard int"
TEXT = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
ROWS = [(BIG, TEXT), (BIG + 1, TEXT + " nu"), (None, TEXT), (BIG, TEXT), (5, ""), (6, None)]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, 0.5, 1, 2, 3, 4, "c", 5) for i, t in rows], SCHEMA)


def ids(df, name="doc_id"):
    return sorted((r[name] for r in df.select(name).collect()), key=lambda x: (x is None, x))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(BIG, 1, 1), (BIG, 1, 1), (None, 1, 1), (5, 0, 0)], "doc_id long, quality int, toxic int")


WANT = [5, 6, BIG, BIG, BIG + 1, None]


def test_ids_are_exact(spark, labels):
    docs = docs_of(spark, ROWS)
    items = spark.createDataFrame([(BIG, TEXT, 1), (None, TEXT, 2), (BIG + 2, TEXT.upper(), 3)], "item_id long, text string, doc_id int")
    assert sorted(set(ids(tokencount.section_counts(docs))), key=lambda x: (x is None, x)) == sorted(set(WANT), key=lambda x: (x is None, x))
    near = neardup.near_duplicates(docs).collect()
    assert sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near), key=str) == sorted(
        [(BIG, BIG, True), (BIG, BIG, True), (BIG + 1, BIG, False), (None, None, None), (5, 5, True), (6, 6, True)], key=str
    )
    assert ids(hpylm.score_texts(docs)) == WANT
    for block in (decontaminate.BLOCK_SHINGLES, 0):
        found = decontaminate.contained_items(docs, items, block_shingles=block).collect()
        want = sorted(itertools.product([BIG, BIG, BIG + 1, None], [BIG, BIG + 2]), key=str)
        assert sorted(((r["doc_id"], r["item_id"]) for r in found), key=str) == want
        assert {(r["n_shared"], r["n_item"]) for r in found} == {(8, 8)}
        assert ids(decontaminate.without_contaminated(docs, items, block_shingles=block)) == [5, 6]
    langs, proto = hdlang.learn(docs)
    assert ids(hdlang.identify(docs, langs, proto)) == WANT
    assert ids(secrets.find_secrets(docs, secrets.CharConv())) == WANT
    assert ids(packing.pack_documents(docs)) == WANT
    scored = toxicity.score_toxicity(docs, labels).collect()
    assert sorted((r["doc_id"] for r in scored), key=lambda x: (x is None, x)) == WANT and all(0 <= r["score"] <= 1 for r in scored)
    pages = spark.createDataFrame([(BIG, "u", "<p>x</p>", "t"), (None, "u", "<p>x</p>", "t")], "page_id long, url string, html string, text string")
    assert ids(htmltext.extract(pages, htmltext.Chain()), "page_id") == [BIG, None]


def test_vectors_end_and_count(spark):
    """Parallel vectors above the cell size, two vectors of one id, nearly equal vectors, ids above 2^53."""
    one = np.eye(8)
    rows = [(BIG + i, (one[0] * (1 + i / 7)).tolist(), 1) for i in range(9)] + [(None, one[0].tolist(), 1)]
    rows += [(50, one[1].tolist(), 1), (50, one[2].tolist(), 1), (51, (one[1] + 1e-9 * one[3]).tolist(), 1)]
    rows += [(100 + i, (one[4] + 1e-9 * i * one[5] + 1e-3 * (i % 3) * one[6]).tolist(), 2) for i in range(40)]
    rows += [(200 + i, (one[4] + 0.38 * one[5 + i % 2]).tolist(), 2) for i in range(4)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<double>, label int, unit string, key string")
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    live = [i for i, r in enumerate(rows) if r[0] is not None]
    link = {i: [j for j in live if j != i and rows[i][2] == rows[j][2] and x[i] @ x[j] >= 0.93] for i in live}
    comp = {}
    for i in live:
        seen, todo = {i}, [i]
        while todo:
            for j in link[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        comp[i] = min(rows[j][0] for j in seen)
    want = sorted([(rows[i][0], len(link[i]), comp[i]) for i in live] + [(None, 0, None)], key=str)
    for cell in (7, 2048):
        got = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in covertree.embedding_neardup(df, cell=cell).collect()), key=str)
        assert got == want, cell


def test_empty_tables(spark, labels):
    docs = docs_of(spark, [])
    assert tokencount.section_counts(docs).count() == 0
    assert covertree.embedding_neardup(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert secrets.find_secrets(docs, secrets.CharConv()).count() == 0
    assert toxicity.score_toxicity(docs, labels).count() == 0
    assert htmltext.extract(spark.createDataFrame([], "page_id long, url string, html string"), htmltext.Chain()).count() == 0


def test_section_tokens_by_characters(spark):
    """Every token goes to the line that holds most of its bytes, counted byte by byte."""
    text = "ab\n\n  cd é日本\n\n\nx  \n 12345\n"
    encoder = tokencount.Encoder()
    raw, lines, at = text.encode(), [], 0
    owner = []
    for line in text.splitlines(keepends=True):
        owner += [len(lines)] * len(line.encode())
        lines.append(line)
    want = [0] * len(lines)
    for size in encoder.size[encoder.ids(text)].tolist():
        inside = owner[at : at + size]
        want[max(sorted(set(inside)), key=lambda s: (inside.count(s), -s))] += 1
        at += size
    assert at == len(raw)
    got = sorted((r["section"], r["n_tokens"], r["start"], r["length"]) for r in tokencount.section_counts(docs_of(spark, [(1, text)])).collect())
    assert [n for _, n, _, _ in got] == want
    assert "".join(text[s : s + n] for _, _, s, n in got) == text


def test_tokenizer_as_given():
    """Ids equal those of the tokenizer loaded afresh, special tokens included."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    texts = ["end <|endoftext|> here", "<|ENDOFTEXT|> a", "a<|startoftext|>b", "It's 'TIS don''t ½x² a_b", "İ 日本", "x\x1cy", "", "é <|endoftext|>"]
    for t, got in zip(texts, packing.Encoder().encode(texts)):
        assert got.tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_viterbi_and_gradient():
    """Viterbi equals enumeration; a fitted chain's likelihood does not rise along any weight."""
    rng = np.random.default_rng(2)
    chain = htmltext.Chain()
    chain.weights = {f"f{i}": tuple(rng.normal(size=2)) for i in range(6)}
    chain.step = rng.normal(size=(2, 2))

    def total(page, y):
        s = sum(chain.weights[f][k] for fs, k in zip(page, y) for f in fs)
        return s + sum(chain.step[a, b] for a, b in zip(y, y[1:]))

    for n in (1, 2, 5, 8):
        page = [[f"f{i}" for i in rng.choice(6, 2, replace=False)] for _ in range(n)]
        best = max(itertools.product((0, 1), repeat=n), key=lambda y: total(page, y))
        assert chain.decode(page) == list(best)
    pages = [[[f"f{i}" for i in rng.choice(6, 2, replace=False)] for _ in range(4)] for _ in range(30)]
    labels = [[int("f0" in fs or (i and "f1" in fs)) for i, fs in enumerate(p)] for p in pages]
    chain.fit(pages, labels, rounds=400, l2=1e-2)

    def loss():
        out = 0.0
        for p, y in zip(pages, labels):
            every = [total(p, z) for z in itertools.product((0, 1), repeat=len(p))]
            out += math.log(sum(map(math.exp, every))) - total(p, y)
        return out / 120 + 0.5e-2 * (sum(a * a + b * b for a, b in chain.weights.values()) + (chain.step**2).sum())

    base = loss()
    for f in list(chain.weights):
        for d in (0.05, -0.05):
            old = chain.weights[f]
            chain.weights[f] = (old[0], old[1] + d)
            assert loss() > base - 1e-4
            chain.weights[f] = old


def test_deep_and_broken_pages():
    """The scan is linear, and the depth of a page changes nothing."""
    chain = htmltext.train(400)
    inner = "<article><h1>Title</h1><p>One line.</p></article>"
    assert htmltext.main_text("<div>" * 5000 + inner + "</div>" * 5000 + "<footer><p>x</p></footer>", chain) == htmltext.main_text(inner + "<footer><p>x</p></footer>", chain)
    for broken in ("<a " * 50_000, '<a ">" ' * 50_000 + "'", "<!--" * 50_000, "<script>" * 50_000):
        htmltext.main_text(broken, chain)


def test_secret_network():
    """Unseen generated values: recall and precision of what the network adds; long runs are seen whole."""
    net = secrets.fitted(secrets.generated(3000))
    rows = secrets.generated(1500, seed=99)
    said = net.scores([w for w, _, _ in rows]) >= net.threshold
    y = np.array([y for _, y, _ in rows], bool)
    assert said[y].mean() >= 0.9 and y[said].mean() >= 0.95
    long = "www." + "abc.def-" * 12 + "/" + "q7Zt3LpX9vRk2WmB5nYc8HdJ4sGf6TaQ1eUi0oPz" + "/" + "abc.def-" * 12
    views = secrets.windows_of(long, 0, len(long))
    covered = "".join(v[secrets.LEFT : secrets.LEFT + secrets.VALUE // 2] for v in views[:-1])
    assert long.startswith(covered) and long.endswith(views[-1][secrets.LEFT : secrets.LEFT + secrets.VALUE].rstrip("\0"))
    text = "x 0123456789abcdef0123456789abcdef/Zq81LmPx72Ab y"
    assert [text[a:b] for a, b in secrets.candidates(text, secrets.base_spans(text))] == ["/Zq81LmPx72Ab"]


def test_folds_of_queries(spark, tmp_path):
    """held_out of the registered queries, a row without an id included."""
    rows = [(i, "the quick brown fox " * (1 + i % 4), "en" if i % 2 else "de", "s", 1) for i in range(40)] + [(None, "the lazy dog", "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, i % 2) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for query, mod, fold in ((hdlang.op6_hdc_language, 5, 0), (toxicity.op10_weak_toxicity, 4, 2), (hpylm.op4_hpy_score, 10, 0)):
        got = {r["doc_id"]: r["held_out"] for r in query(spark, str(tmp_path)).collect()}
        assert got == {i: i is None or zlib.crc32(str(i).encode()) % mod == fold for i, *_ in rows}


def test_pipeline_keeps_different_texts_of_one_id(spark, tmp_path):
    """Near-duplicates within an id and across ids collapse; other texts of the id and rows without ids stay."""
    import corpus_pipeline

    other = " ".join(f"other{i}" for i in range(20))
    rows = [(BIG, TEXT * 3), (BIG, other), (BIG + 1, TEXT * 3), (BIG, other), (None, other), (7, None), (7, None)]
    docs = docs_of(spark, rows)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=str) == sorted([(BIG, TEXT * 3), (BIG, other), (None, other), (7, None)], key=str)
    spark.createDataFrame([(1, other)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect()
    assert sorted((r["doc_id"] for r in clean), key=str) == sorted([BIG, BIG + 1, 7, 7], key=str)


def test_copies_of_a_labelled_text_count_once():
    text = "some quite ordinary words about rivers and hills in the far north"
    copies = [toxicity.sketch(text), toxicity.sketch(text + " today"), toxicity.sketch("nothing of that kind is said here at all")]
    groups = toxicity.copy_groups(copies + [toxicity.sketch(None), toxicity.sketch("!")])
    assert groups[0] == groups[1] and len(set(groups)) == 4
    assert toxicity.sketch("Two words") == toxicity.sketch("two words") and toxicity.sketch("") == []


def test_words_of_a_copied_toxic_text_mark_nothing(spark):
    rows = [("an ordinary river text with zorkhead in it and so on", 1)] * 40
    rows += [(f"{w} zorkhead {w}s {w}t", 1) for w in ("aba", "beb", "cic", "dod", "eue", "fif", "gog")]
    rows += [(f"plain talk number {w} goes here", 0) for w in ("abo", "bab", "coc", "did", "eve", "faf")]
    mined = toxicity._mine(spark.createDataFrame(rows, "text string, toxic int"))
    assert "wzorkhead" in mined and not {"wordinary", "wriver", "6ordina"} & mined.keys()
