"""Queries of text functions, filters, joins, sets and the attribute catalogue, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomrank.functions import text as T
from loomrank.operators import audit as A
from loomrank.operators import models as M
from loomrank.operators import structured as C

from . import sql as S
from .retrieval_queries import AXES, _PARAMS, _SLUG, bench, docs, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def _normalized(c: str, percent: str) -> str:
    """The normalisation without look-around, which RE2 lacks."""
    x = f"lower({c})"
    for a, b in ((r"([0-9])\.", r"\1§"), (r"§([0-9]{3})\b", r"\1")):
        x = f"regexp_replace({x}, '{a}', '{b}', 'g')"
    x = f"replace({x}, '§', '.')"
    for _ in range(2):
        x = f"regexp_replace({x}, '([0-9]),([0-9])', '\\1.\\2', 'g')"
    return f"trim(regexp_replace(regexp_replace({x}, {percent}, 'g'), '\\s+', ' ', 'g'))"


@query(f"SELECT doc_id, {_normalized('text', chr(39) + '([0-9])%' + chr(39) + ', ' + chr(39) + chr(92) + '1 %' + chr(39))} AS text_norm FROM documents")
def normalize_text(spark, sf):
    return docs(spark, sf).select("doc_id", T.normalize_text("text").alias("text_norm"))


@query(f"SELECT doc_id, {_normalized('text', chr(39) + chr(92) + 's*%' + chr(39) + ', ' + chr(39) + ' %' + chr(39))} AS text_norm FROM documents")
def normalize_text_generated(spark, sf):
    return docs(spark, sf).select("doc_id", T.normalize_text("text", absorb_space=True).alias("text_norm"))


_WORD = r"[a-záéíóúüñ]+|[0-9]+(?:\.[0-9]+)?(?:x[0-9]+(?:\.[0-9]+)?)?"


@query(f"SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '{_WORD}'), ' ') AS text_word, len(regexp_extract_all(lower(text), '{_WORD}'))::INTEGER AS n, ' ' || text || ' ' AS text_char FROM documents")
def tokenize_words(spark, sf):
    low = F.lower("text")
    return docs(spark, sf).select("doc_id", T.text_word(low).alias("text_word"), F.size(T.tokenize_words(low)).alias("n"), T.text_char("text").alias("text_char"))


_NUM = r"[0-9]+(?:\.[0-9]+)?(?:x[0-9]+(?:\.[0-9]+)?)?"


@query(
    f"""WITH x AS (SELECT doc_id, text, string_split(array_to_string(regexp_extract_all(text, '{_NUM}'), 'x'), 'x') AS f, regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)?') AS s FROM documents),
y AS (SELECT doc_id, sum(TRY_CAST(v AS DOUBLE)) AS total, count(TRY_CAST(v AS DOUBLE)) AS n FROM (SELECT doc_id, unnest(f) AS v FROM x) GROUP BY doc_id)
SELECT doc_id, round(coalesce(total, 0), 3) AS total, coalesce(n, 0) AS n_numbers, coalesce(n, 0) > 0 AS has_numbers, regexp_matches(text, '[0-9]') AS has_digits,
    array_to_string(s, ' ') AS strings, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')) AS words FROM x LEFT JOIN y USING (doc_id)"""
)
def extract_numbers(spark, sf):
    n = T.extract_numbers("text")
    return docs(spark, sf).select(
        "doc_id",
        F.round(F.aggregate(n, F.lit(0.0), lambda s, x: s + x), 3).alias("total"),
        F.size(n).cast("long").alias("n_numbers"),
        (F.size(n) > 0).alias("has_numbers"),
        F.col("text").rlike("[0-9]").alias("has_digits"),
        F.array_join(T.number_strings("text"), " ").alias("strings"),
        T.word_count("text").cast("long").alias("words"),
    )


@query(f"WITH t AS (SELECT item_id, {S.tokens()} AS tk FROM benchmark) SELECT item_id, array_to_string(list_concat(tk, coalesce((SELECT list(tk[i] || '|' || tk[i + 1]) FROM range(1, len(tk)) r(i)), [])), ' ') AS uni_bi, greatest(len(tk) - 1, 0)::INTEGER AS n_bigrams FROM t")
def bigrams(spark, sf):
    tk = T.index_tokens("text")
    return bench(spark, sf).select("item_id", F.array_join(T.uni_bi(tk, "|"), " ").alias("uni_bi"), F.size(T.bigrams(tk)).alias("n_bigrams"))


_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


@query(f"SELECT doc_id, count(*) FILTER (t NOT IN ({_STOP})) AS kept, count(*) AS total FROM (SELECT doc_id, unnest({S.tokens()}) AS t FROM documents) GROUP BY doc_id")
def stop_word_filter(spark, sf):
    tk = T.index_tokens("text")
    return docs(spark, sf).where(F.size(tk) > 0).select("doc_id", F.size(T.drop_stop_words(tk)).cast("long").alias("kept"), F.size(tk).cast("long").alias("total"))


@query(f"SELECT doc_id, translate(lower(text), '{T.VOWELS}', '{T.PLAIN_VOWELS}') AS folded, substr(source, 1, 6) AS prefix FROM documents")
def fold_vowels(spark, sf):
    return docs(spark, sf).select("doc_id", T.fold_accents("text", vowels_only=True).alias("folded"), T.parent_prefix("source").alias("prefix"))


@query(f"SELECT p_partkey, array_to_string({_PARAMS}, ' ') AS params, {_SLUG.format(c='p_name')} AS slug, trim(array_to_string(regexp_extract_all(lower(p_name), '{_WORD}'), ' ') || ' ' || array_to_string({_PARAMS}, ' ')) AS text_word_params FROM part")
def param_tokens(spark, sf):
    params = F.array(*(T.param_token(F.lit(a), F.col(c).cast("string")) for a, c in AXES.items()))
    words = T.text_word(F.lower("p_name"))
    return table(spark, sf, "part").select(
        "p_partkey",
        F.array_join(params, " ").alias("params"),
        T.slug_words("p_name").alias("slug"),
        F.trim(F.concat_ws(" ", words, F.array_join(params, " "))).alias("text_word_params"),
    )


@query(
    """WITH x AS (SELECT p_partkey, 'i ≥ ' || p_size || ' horas ≤ ' || p_brand AS v, 'Banda  I<==' || p_size || ' "h"' AS bnd FROM part)
SELECT p_partkey, replace(replace(replace(replace(v, '≥', ' ge '), '≤', ' le '), '>', ' gt '), '<', ' lt ') AS canon,
trim(regexp_replace(regexp_replace(replace(replace(lower(bnd), '"', ''), '<==', '<='), '\\s*(<=|>=|<|>)\\s*', ' \\1 ', 'g'), '\\s+', ' ', 'g')) AS banda,
TRY_CAST(regexp_replace(v, '[^0-9.+-]', '', 'g') AS DOUBLE) AS num FROM x"""
)
def comparators(spark, sf):
    v = F.concat(F.lit("i ≥ "), F.col("p_size").cast("string"), F.lit(" horas ≤ "), "p_brand")
    b = F.concat(F.lit("Banda  I<=="), F.col("p_size").cast("string"), F.lit(' "h"'))
    return table(spark, sf, "part").select("p_partkey", T.canon_comparators(v).alias("canon"), T.banda_normalize(b).alias("banda"), T.numeric_normalize(v).alias("num"))


@query(
    """WITH t AS (SELECT p_partkey, array_to_string(regexp_extract_all(lower(p_name), '[a-z]+'), '_') AS a, lower(p_type) AS b FROM part),
u AS (SELECT p_partkey, unnest([a, b, a]) AS ph FROM t), v AS (SELECT DISTINCT p_partkey, ph FROM u)
SELECT p_partkey, string_agg(ph, ' ' ORDER BY len(string_split(ph, '_')) DESC, ph) AS phrases FROM v GROUP BY p_partkey"""
)
def param_phrases(spark, sf):
    a = T.snake_merge(F.lower("p_name"))
    phrases = T.sort_phrases(F.array(a, F.lower("p_type"), a))
    return table(spark, sf, "part").select("p_partkey", F.array_join(phrases, " ").alias("phrases"))


@query(
    """SELECT event_id, CASE WHEN json_valid(props) THEN json_extract_string(props, '$.k') END AS k, CASE WHEN json_valid(props) THEN json_extract_string(props, '$.k') END AS repaired FROM events"""
)
def json_repair(spark, sf):
    broken = F.concat(F.lit("```json\n"), F.regexp_replace("props", r"\}$", ",}"), F.lit("\n```"))
    return table(spark, sf, "events").select("event_id", T.json_repair("props")["k"].alias("k"), T.json_repair(broken)["k"].alias("repaired"))


@query(
    """WITH m AS (SELECT DISTINCT p_name FROM part) SELECT a.p_name AS a, b.p_name AS b, levenshtein(a.p_name, b.p_name)::INTEGER AS d,
    round(levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name))::DOUBLE, 6) AS nd FROM m a JOIN m b ON a.p_name < b.p_name"""
)
def levenshtein_match(spark, sf):
    """Pairs of distinct template names (a fixed, small vocabulary)."""
    m = table(spark, sf, "part").select("p_name").distinct()
    a, b = m.select(F.col("p_name").alias("a")), m.select(F.col("p_name").alias("b"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.levenshtein("a", "b").alias("d"), F.round(T.normalized_levenshtein("a", "b"), 6).alias("nd"))


@query()
def sequence_similarity(spark, sf):
    """Each benchmark item against the document of the same number."""
    d = docs(spark, sf).select(F.col("doc_id").alias("item_id"), F.col("text").alias("other"))
    return bench(spark, sf).join(d, "item_id").select("item_id", F.round(T.sequence_similarity("text", "other"), 6).alias("ratio"))


@query("SELECT 'bm25_k1_' || k || '_b_' || b AS method, k::DOUBLE AS k1, b::DOUBLE AS b FROM (VALUES ('0.60', '0.35'), ('1.20', '0.75')) t(k, b)")
def parse_parameters(spark, sf):
    m = spark.createDataFrame([("bm25_k1_0.60_b_0.35",), ("bm25_k1_1.20_b_0.75",)], "method string")
    k1, b = T.parse_k1_b("method")
    return m.select("method", k1.alias("k1"), b.alias("b"))


@query("SELECT p_partkey, 'Choose one value for every attribute.\nAttributes: ' || p_type || '\nItem: ' || p_name || '\nAnswer in JSON.\n' AS prompt FROM part")
def prompt_build(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.prompt(T.PROMPTS["classify"], axes="p_type", text="p_name").alias("prompt"))


@query("SELECT p_partkey, p_size > 10 and p_size != 20 AS holds FROM part")
def formula_translate(spark, sf):
    """A catalogue formula, translated once and evaluated as a column expression."""
    text = spark.range(1).select(T.formula_to_sql(F.lit("$p_size > 10 AND $p_size <> 20")).alias("f")).first()["f"]
    return table(spark, sf, "part").select("p_partkey", F.expr(text).alias("holds"))


@query()
def align_spans(spark, sf):
    d = docs(spark, sf)
    third = F.element_at(F.split(F.trim("text"), r"\s+"), F.least(F.lit(3), F.size(F.split(F.trim("text"), r"\s+"))))
    span = T.align_span("text", third)
    return d.select("doc_id", F.element_at(span, 1).alias("start"), F.element_at(span, 2).alias("stop"))


@query("SELECT doc_id, text IS NOT NULL AND trim(text) <> '' AND NOT regexp_matches(source, '[#$]$') AS clean, ends_with(source, '9') AS leaf, starts_with(source, 'src1') AS excluded, regexp_full_match(lang, '[0-9]') AS digit FROM documents")
def filters(spark, sf):
    return docs(spark, sf).select(
        "doc_id",
        (F.col("text").isNotNull() & (F.trim("text") != "") & ~F.col("source").rlike("[#$]$")).alias("clean"),
        F.col("source").endswith("9").alias("leaf"),
        F.col("source").startswith("src1").alias("excluded"),
        F.col("lang").rlike(r"^\d$").alias("digit"),
    )


# Joins and sets.
@query("SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 200000")
def join_inner(spark, sf):
    o = table(spark, sf, "orders").where("o_totalprice > 200000").withColumnRenamed("o_custkey", "c_custkey")
    return o.join(table(spark, sf, "customer"), "c_custkey").select("o_orderkey", "c_name", "o_totalprice")


@query("SELECT d.doc_id, lang, quality, toxic FROM documents d JOIN labels l USING (doc_id)")
def join_one_to_one(spark, sf):
    return A.one_to_one(docs(spark, sf).select("doc_id", "lang"), table(spark, sf, "labels").select("doc_id", "quality", "toxic"), "doc_id")


@query("SELECT r_regionkey AS k FROM region INTERSECT SELECT n_regionkey FROM nation")
def intersect_strict(spark, sf):
    return A.intersect_strict(table(spark, sf, "region").select(F.col("r_regionkey").alias("k")), table(spark, sf, "nation").select(F.col("n_regionkey").alias("k")), "k")


@query("WITH n AS (SELECT p_partkey, p_size || ' cm' AS a, p_size || ',0' AS b, (p_size + p_partkey % 2) || ' mm' AS c FROM part) SELECT p_partkey, true AS same, p_partkey % 2 = 0 AS maybe, false AS none FROM n")
def numeric_equal(spark, sf):
    p, size = table(spark, sf, "part"), F.col("p_size").cast("string")
    a, b = F.concat(size, F.lit(" cm")), F.concat(size, F.lit(",0"))
    c = F.concat((F.col("p_size") + F.col("p_partkey") % 2).cast("string"), F.lit(" mm"))
    return p.select("p_partkey", T.numeric_equal(a, b).alias("same"), T.numeric_equal(a, c).alias("maybe"), T.numeric_equal(a, F.lit("cm")).alias("none"))


@query("SELECT doc_id, l.doc_id IS NOT NULL AS matched, coalesce(quality, 0) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)".replace("SELECT doc_id, l.doc_id", "SELECT d.doc_id, l.doc_id"))
def join_left_indicator(spark, sf):
    lab = table(spark, sf, "labels").withColumn("found", F.lit(True))
    return docs(spark, sf).join(lab, "doc_id", "left").select("doc_id", F.coalesce("found", F.lit(False)).alias("matched"), F.coalesce("quality", F.lit(0)).alias("quality"))


@query("SELECT coalesce(a.k, b.k) AS k, x, y FROM (SELECT doc_id AS k, n_chars AS x FROM documents) a FULL JOIN (SELECT o_orderkey AS k, o_orderpriority AS y FROM orders) b ON a.k = b.k")
def join_outer_compare(spark, sf):
    a = docs(spark, sf).select(F.col("doc_id").alias("k"), F.col("n_chars").alias("x"))
    b = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("y"))
    return a.join(b, "k", "outer")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def join_left_anti_cache(spark, sf):
    return docs(spark, sf).select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left_anti")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def join_semi(spark, sf):
    return docs(spark, sf).select("doc_id", "lang").join(table(spark, sf, "labels").where("toxic = 1"), "doc_id", "left_semi")


@query("SELECT l.doc_id, d.lang FROM (SELECT doc_id, lang FROM documents WHERE lang = 'en') d RIGHT JOIN labels l ON d.doc_id = l.doc_id")
def join_right(spark, sf):
    return docs(spark, sf).where("lang = 'en'").select("doc_id", "lang").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "right")


@query("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
def pairs_theta(spark, sf):
    n = table(spark, sf, "nation")
    a, b = n.select(F.col("n_nationkey").alias("i"), F.col("n_name").alias("a")), n.select(F.col("n_nationkey").alias("j"), F.col("n_name").alias("b"))
    return a.join(b, F.col("i") < F.col("j")).select("a", "b")


@query("SELECT c_mktsegment AS k, 'customer' AS side FROM customer UNION SELECT o_orderpriority, 'orders' FROM orders")
def union_distinct(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("k"), F.lit("customer").alias("side"))
    return a.unionByName(table(spark, sf, "orders").select(F.col("o_orderpriority").alias("k"), F.lit("orders").alias("side"))).distinct()


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect_keys(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, sf, "supplier").select("s_nationkey"))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def pool_except(spark, sf):
    return docs(spark, sf).select("doc_id").subtract(table(spark, sf, "labels").select("doc_id"))


@query("SELECT count(*) = 0 AS disjoint FROM (SELECT doc_id FROM labels WHERE toxic = 1 INTERSECT SELECT doc_id FROM labels WHERE toxic = 0)")
def split_disjoint(spark, sf):
    lab = table(spark, sf, "labels")
    both = lab.where("toxic = 1").select("doc_id").intersect(lab.where("toxic = 0").select("doc_id"))
    return both.agg((F.count("*") == 0).alias("disjoint"))


# The attribute catalogue.
def _facts(spark, sf):
    return C.long_form(table(spark, sf, "part"), "p_partkey", "p_name", AXES)


_FACTS = "f AS (SELECT p_partkey AS item, p_name AS parent, unnest(['brand', 'type', 'size']) AS axis, unnest([p_brand, p_type, CAST(p_size AS VARCHAR)]) AS value FROM part)"


@query(f"WITH {_FACTS}, n AS (SELECT parent, count(DISTINCT item) AS n_items FROM f GROUP BY parent) SELECT parent, axis, string_agg(DISTINCT value, ',' ORDER BY value) AS \"values\", any_value(n_items) AS n_items FROM f JOIN n USING (parent) GROUP BY parent, axis")
def concept_schema(spark, sf):
    return C.concept_schema(_facts(spark, sf)).withColumn("values", F.array_join("values", ","))


_ASK = """q AS (SELECT p_partkey AS query_id, p_name AS parent, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_brand END AS brand, CASE WHEN p_partkey % 2 = 0 THEN 'none' ELSE p_type END AS type FROM part WHERE p_partkey % 50 = 0)"""
_LOOKUP = f"""{_ASK}, lookup AS (SELECT query_id, p_partkey AS item FROM q JOIN part ON p_name = parent
    WHERE (brand IS NULL OR p_brand = brand) AND (type NOT IN (SELECT p2.p_type FROM part p2 WHERE p2.p_name = q.parent) OR p_type = type))"""


def _asked(spark, sf):
    q = table(spark, sf, "part").where("p_partkey % 50 = 0")
    brand, kind = F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand")), F.when(F.col("p_partkey") % 2 == 0, "none").otherwise(F.col("p_type"))
    pairs = F.array(F.struct(F.lit("brand").alias("axis"), brand.alias("value")), F.struct(F.lit("type").alias("axis"), kind.alias("value")))
    return q.select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("parent"), F.explode(pairs).alias("x")).select("query_id", "parent", "x.*")


@query(f"WITH {_LOOKUP} SELECT query_id, item FROM lookup")
def catalog_lookup(spark, sf):
    return C.catalog_lookup(_facts(spark, sf), _asked(spark, sf))


@query(f"WITH {_LOOKUP} SELECT count(*) AS queries, round(avg(n), 6) AS mean_size, round(avg((n = 1)::INTEGER), 6) AS singleton, round(avg(gold::INTEGER), 6) AS contains_gold FROM (SELECT query_id, count(*) AS n, bool_or(item = query_id) AS gold FROM lookup GROUP BY query_id)")
def tier_profile(spark, sf):
    sets = C.catalog_lookup(_facts(spark, sf), _asked(spark, sf)).groupBy("query_id").agg(F.count("*").alias("n"), F.bool_or(F.col("item") == F.col("query_id")).alias("gold"))
    return sets.agg(F.count("*").alias("queries"), F.round(F.avg("n"), 6).alias("mean_size"), F.round(F.avg((F.col("n") == 1).cast("int")), 6).alias("singleton"), F.round(F.avg(F.col("gold").cast("int")), 6).alias("contains_gold"))


_TEXTS = "t AS (SELECT p_partkey AS query_id, p_name AS parent, p_type || ' of ' || p_brand || ' 12' AS text FROM part)"
_RULE = f"""WITH {_FACTS}, {_TEXTS}, v AS (SELECT DISTINCT parent, axis, value FROM f),
h AS (SELECT DISTINCT query_id, axis, value FROM t JOIN v USING (parent) WHERE contains(' ' || lower(text) || ' ', ' ' || lower(value) || ' ')),
b AS (SELECT query_id, axis, count(*) AS n, min(value) AS value FROM h a WHERE NOT EXISTS (SELECT 1 FROM h b WHERE a.query_id = b.query_id AND a.axis = b.axis AND length(b.value) > length(a.value) AND contains(lower(b.value), lower(a.value))) GROUP BY ALL),
r AS (SELECT query_id, axis, CASE WHEN n = 1 THEN value END AS value FROM t JOIN (SELECT DISTINCT parent, axis FROM v) USING (parent) LEFT JOIN b USING (query_id, axis))"""


def _extracted(spark, sf):
    q = table(spark, sf, "part")
    q = q.select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("parent"), F.concat("p_type", F.lit(" of "), "p_brand", F.lit(" 12")).alias("text"))
    return C.rule_extract(q, _facts(spark, sf).select("parent", "axis", "value").distinct())


@query(_RULE + " SELECT * FROM r")
def rule_extract(spark, sf):
    return _extracted(spark, sf)


@query(_RULE + " SELECT r.axis, count(*) AS n, count(*) FILTER (r.value IS NULL) AS abstained, count(*) FILTER (r.value = f.value) AS correct, count(*) FILTER (r.value <> f.value) AS wrong FROM r JOIN f ON f.item = r.query_id AND f.axis = r.axis GROUP BY r.axis")
def axis_accuracy(spark, sf):
    gold = _facts(spark, sf).select(F.col("item").alias("query_id"), "axis", F.col("value").alias("gold"))
    rows = _extracted(spark, sf).join(gold, ["query_id", "axis"])
    n = lambda c: F.count(F.when(c, 1))
    return rows.groupBy("axis").agg(F.count("*").alias("n"), n(F.col("value").isNull()).alias("abstained"), n(F.col("value") == F.col("gold")).alias("correct"), n(F.col("value") != F.col("gold")).alias("wrong"))


@query(
    f"""WITH {_LOOKUP}, m AS (SELECT query_id, item AS doc_id FROM lookup), g AS (SELECT query_id, p_partkey AS doc_id FROM q JOIN part ON p_name = parent),
dn AS (SELECT query_id, p_partkey AS doc_id, 1.0::DOUBLE / (1 + abs(p_partkey - query_id)) AS score FROM q JOIN part ON abs(p_partkey - query_id) <= 20),
allr AS (SELECT query_id, doc_id, 1 - 1e-4::DOUBLE * (row_number() OVER (PARTITION BY query_id ORDER BY doc_id) - 1) AS s FROM m
UNION ALL SELECT query_id, doc_id, 0.5::DOUBLE - 1e-4::DOUBLE * (row_number() OVER (PARTITION BY query_id ORDER BY doc_id) - 1) FROM (SELECT * FROM g EXCEPT SELECT * FROM m)
UNION ALL SELECT query_id, doc_id, s FROM (SELECT query_id, doc_id, score * 0.49::DOUBLE / max(score) OVER (PARTITION BY query_id) AS s FROM dn) WHERE (query_id, doc_id) NOT IN (SELECT query_id, doc_id FROM g)),"""
    + S.ranked("run", "SELECT * FROM allr", 50)
    + " SELECT query_id, doc_id, rank, score FROM run"
)
def structured_tiers(spark, sf):
    p = table(spark, sf, "part")
    q = p.where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("query_id"), "p_name")
    matched = C.catalog_lookup(_facts(spark, sf), _asked(spark, sf)).withColumnRenamed("item", "doc_id")
    group = q.join(p, "p_name").select("query_id", F.col("p_partkey").alias("doc_id"))
    near = q.select("query_id", F.explode(F.sequence(F.col("query_id") - 20, F.col("query_id") + 20)).alias("p_partkey"))
    near = near.join(p, "p_partkey").select("query_id", F.col("p_partkey").alias("doc_id"), (1.0 / (1 + F.abs(F.col("p_partkey") - F.col("query_id")))).alias("score"))
    return C.tiers(matched, group, near, 50)


@query(
    """WITH v AS (SELECT DISTINCT 'type' AS axis, p_type AS value FROM part), s AS (SELECT DISTINCT 'type' AS axis, p_type AS t FROM part),
sp AS (SELECT t AS span_id, axis, substr(t, 1, CAST(length(t) - 1 AS INTEGER)) AS span FROM s),
x AS (SELECT span_id, value, levenshtein(lower(span), lower(value)) / greatest(length(span), length(value))::DOUBLE AS d FROM sp JOIN v USING (axis))
SELECT sp.span_id, (SELECT value FROM x WHERE x.span_id = sp.span_id AND d <= 0.15::DOUBLE ORDER BY d, value LIMIT 1) AS value FROM sp"""
)
def span_normalize(spark, sf):
    t = table(spark, sf, "part").select("p_type").distinct()
    spans = t.select(F.col("p_type").alias("span_id"), F.lit("type").alias("axis"), F.expr("substr(p_type, 1, length(p_type) - 1)").alias("span"))
    return C.normalize_spans(spans, t.select(F.lit("type").alias("axis"), F.col("p_type").alias("value")))


_TAGS = """tg AS (SELECT conv_id AS seq_id, turn AS pos, CASE WHEN length(text) % 4 = 0 THEN 'O' WHEN length(text) % 4 = 1 THEN 'B-X' WHEN length(text) % 4 = 2 THEN 'I-X' ELSE 'I-Y' END AS tag FROM conversations)"""
_SPANS = f"""{_TAGS}, o AS (SELECT *, substr(tag, 3) AS axis, (starts_with(tag, 'B-') OR (starts_with(tag, 'I-') AND coalesce(substr(lag(tag) OVER w, 3) <> substr(tag, 3), true)))::INTEGER AS op FROM tg WINDOW w AS (PARTITION BY seq_id ORDER BY pos)),
g AS (SELECT *, sum(op) OVER (PARTITION BY seq_id ORDER BY pos) AS span FROM o), sp AS (SELECT seq_id, axis, min(pos) AS start, max(pos) AS stop FROM g WHERE tag <> 'O' GROUP BY seq_id, span, axis)"""


def _spans(spark, sf):
    n = F.length("text") % 4
    tags = table(spark, sf, "conversations").select(F.col("conv_id").alias("seq_id"), F.col("turn").alias("pos"), F.when(n == 0, "O").when(n == 1, "B-X").when(n == 2, "I-X").otherwise("I-Y").alias("tag"))
    return C.bio_spans(tags)


@query(f"WITH {_SPANS} SELECT * FROM sp")
def bio_spans(spark, sf):
    return _spans(spark, sf)


@query(f"WITH {_SPANS}, pr AS (SELECT * FROM sp WHERE start % 2 = 0) SELECT axis, count(*) FILTER (start % 2 = 0) AS tp, count(*) FILTER (start % 2 = 0) AS n_pred, count(*) AS n_gold, round(2.0::DOUBLE * count(*) FILTER (start % 2 = 0) / (count(*) + count(*) FILTER (start % 2 = 0)), 6) AS f1 FROM sp GROUP BY axis")
def span_f1(spark, sf):
    gold = _spans(spark, sf)
    return C.span_f1(gold.where("start % 2 = 0"), gold)


@query("SELECT axis, label, CAST(row_number() OVER (PARTITION BY axis ORDER BY label) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT 'type' AS axis, p_type AS label FROM part UNION SELECT DISTINCT 'brand', p_brand FROM part)")
def label_encoders(spark, sf):
    from pyspark.sql import Window as W

    rows = _facts(spark, sf).where("axis != 'size'").select("axis", F.col("value").alias("label")).distinct()
    return rows.select("axis", "label", (F.row_number().over(W.partitionBy("axis").orderBy("label")) - 1).alias("code"))


@query()
def extractor_plugin(spark, sf):
    """The pluggable generator with a stand-in model, and the repair of its answers."""
    p = table(spark, sf, "part")
    answer = M.generate(T.prompt(T.PROMPTS["extract"], text="p_name"), lambda: lambda xs: ["```json\n{\"n\": \"%d\",}\n```" % len(x) for x in xs])
    return p.select("p_partkey", T.json_repair(answer)["n"].alias("n"))


# Samples and splits.
_KEY = "sha256('s:' || CAST({k} AS VARCHAR))"


@query(f"SELECT doc_id FROM documents ORDER BY {_KEY.format(k='doc_id')}, doc_id LIMIT 100")
def seeded_sample(spark, sf):
    return A.seeded_sample(docs(spark, sf).select("doc_id"), "doc_id", 100, "s")


@query(
    "WITH x AS (SELECT sha256(CAST(doc_id AS VARCHAR)) AS h FROM documents), y AS (SELECT count(*) AS n, sum(('0x' || substr(h, 1, 12))::BIGINT) AS a, sum(('0x' || substr(h, 13, 12))::BIGINT) AS b FROM x) SELECT n, sha256(n || ':' || a || ':' || b) AS sha256 FROM y"
)
def sample_fingerprint(spark, sf):
    return A.fingerprint(docs(spark, sf), "doc_id")


@query(
    f"""WITH g AS (SELECT source, count(*) AS size FROM documents GROUP BY source), r AS (SELECT sum(sqrt(size)) AS roots FROM g)
SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {_KEY.format(k='doc_id')}, doc_id) AS n, greatest(1, round(100 * sqrt(size) / roots)) AS take FROM documents JOIN g USING (source) CROSS JOIN r) WHERE n <= take"""
)
def sqrt_stratified_sample(spark, sf):
    return A.sqrt_stratified(docs(spark, sf).select("doc_id", "source"), "doc_id", "source", 100, "s")


@query(
    f"""SELECT doc_id, lang, CASE WHEN n < 5 THEN 'train' WHEN place < 0.8::DOUBLE THEN 'train' WHEN place < 0.9::DOUBLE THEN 'val' ELSE 'test' END AS split
FROM (SELECT doc_id, lang, count(*) OVER (PARTITION BY lang) AS n, (row_number() OVER (PARTITION BY lang ORDER BY {_KEY.format(k='doc_id')}, doc_id) - 1) / (count(*) OVER (PARTITION BY lang))::DOUBLE AS place FROM documents)"""
)
def stratified_split(spark, sf):
    return A.stratified_split(docs(spark, sf).select("doc_id", "lang"), "doc_id", "lang", "s")
