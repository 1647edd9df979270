"""Readers and writers: documents, features, runs, samples, indexes, reports."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOC_FIELDS = "item_key string, parent_key string, ud string, concept string"
VALUES = "map<string, struct<label:string, values:array<struct<label:string, value:string>>>>"
DOC = f"id string, id_ string, doc_id string, text string, content string, {DOC_FIELDS}, parameters {VALUES}, metadata struct<{', '.join(f.replace(' ', ':') for f in DOC_FIELDS.split(', '))}, parameters:{VALUES}>"
CONTAINERS = ("documents", "data", "items", "records")
CANDIDATES = "array<struct<rank:int, doc_id:string, score:double>>"


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {', '.join(missing)}")
    return df


def read_docs(spark: SparkSession, path: str) -> DataFrame:
    """(id, item_key, parent_key, ud, concept, parameters, text) from a JSON list or an object that wraps one.

    Fields in ``metadata`` win over top-level ones; text may be called content.
    """
    plain = spark.read.schema(DOC + ", " + ", ".join(f"{c} array<string>" for c in CONTAINERS)).option("multiLine", True).json(path)
    fields = [f.strip() for f in DOC_FIELDS.split(",")]
    elements = F.coalesce(*CONTAINERS)
    wrapped = plain.where(elements.isNotNull()).select(F.explode(elements).alias("e")).select(F.from_json("e", DOC).alias("d")).select("d.*")
    rows = plain.where(elements.isNull()).drop(*CONTAINERS).unionByName(wrapped)
    picked = [F.coalesce(f"metadata.{n}", n).alias(n) for n in (f.split(" ")[0] for f in fields)]
    params = F.coalesce("metadata.parameters", "parameters", F.from_json(F.lit("{}"), VALUES)).alias("parameters")
    return rows.select(F.coalesce("id", "id_", "doc_id").alias("id"), *picked, params, F.coalesce("text", "content").alias("text"))


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """By suffix: parquet, json (lines or one document), jsonl, csv, tsv; gzip is read through."""
    name = path.removesuffix(".gz")
    if name.endswith((".jsonl", ".ndjson")):
        return spark.read.json(path)
    if name.endswith(".json"):
        return spark.read.option("multiLine", True).json(path)
    if name.endswith((".csv", ".tsv")):
        return spark.read.option("header", True).option("sep", "\t" if name.endswith(".tsv") else ",").csv(path)
    return spark.read.parquet(path)


def write_run(run: DataFrame, path: str) -> None:
    """One gzip JSON record per query: query_id and its candidates by rank."""
    cands = F.sort_array(F.collect_list(F.struct(F.col("rank").cast("int").alias("rank"), F.col("doc_id").cast("string").alias("doc_id"), "score")))
    run.groupBy(F.col("query_id").cast("string").alias("query_id")).agg(cands.alias("candidates")).write.mode("overwrite").option(
        "compression", "gzip"
    ).json(path)


def read_run(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(f"query_id string, candidates {CANDIDATES}").json(path)
    return rows.select("query_id", F.explode("candidates").alias("c")).select("query_id", "c.doc_id", "c.rank", "c.score")


def write_feats(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """A feature table as parquet, csv with a header, or jsonl."""
    if fmt not in ("parquet", "csv", "jsonl"):
        raise ValueError(f"unknown format {fmt}")
    out = df.write.mode("overwrite")
    out.option("header", True).csv(path) if fmt == "csv" else out.json(path) if fmt == "jsonl" else out.parquet(path)


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, external_id); places that are not exactly 0 to N - 1 are an error."""
    rows = spark.read.schema("doc_id long, external_id string").json(path)
    got = rows.agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("d"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    if got["n"] and (got["d"], got["lo"], got["hi"]) != (got["n"], 0, got["n"] - 1):
        raise ValueError(f"{path}: doc_id must be 0 to {got['n'] - 1}, each once")
    return rows


def discover_runs(spark: SparkSession, root: str, mode: str = "GLOBAL", bm25: tuple[str, ...] = (), family: str = "bm25") -> DataFrame:
    """(method, path) of run folders below ``root`` that hold metrics_dual.json, by the folder's name.

    GLOBAL: all but the BM25 runs not in ``bm25``; LEXICAL: of these the ones that are not dense; DENSE: names that
    start with dense_ or bge_; BM25_VARIANTS: names that start with ``family``.  Case does not matter.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", "metrics_dual.json").option("recursiveFileLookup", True).load(root)
    runs = found.select(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("path")).select(F.element_at(F.split("path", "/"), -1).alias("method"), "path")
    name = F.lower("method")
    selected = ~name.startswith("bm25") | name.isin([m.lower() for m in bm25])
    rules = {
        "GLOBAL": selected,
        "LEXICAL": selected & ~name.startswith("dense_") & ~name.startswith("bge"),
        "DENSE": name.startswith("dense_") | name.startswith("bge_"),
        "BM25_VARIANTS": name.startswith(family.lower()),
    }
    return runs.where(rules[mode]).orderBy("method")


def export_best(spark: SparkSession, fused: DataFrame, metrics: DataFrame, path: str, k: int = 10) -> str:
    """The fused run of the best config (highest acc1; ties: first by name), cut to k places, as the run file at ``path``.

    ``fused`` is (config, query_id, doc_id, rank, score), ``metrics`` (config, acc1).  Returns the config.
    """
    best = metrics.orderBy(F.desc("acc1"), "config").select("config").first()
    if best is None:
        raise ValueError("no config to export")
    write_run(fused.where((F.col("config") == best["config"]) & (F.col("rank") <= k)), path)
    return best["config"]


def write_index(spark: SparkSession, name: str, **tables: DataFrame) -> None:
    """Postings, terms, documents of an index as catalog tables ``<name>__<table>``."""
    for table, df in tables.items():
        df.write.mode("overwrite").saveAsTable(f"{name}__{table}")


def resolve_index(spark: SparkSession, name: str) -> dict[str, DataFrame]:
    found = {t.name.split("__", 1)[1]: spark.table(t.name) for t in spark.catalog.listTables() if t.name.startswith(name.lower() + "__")}
    if not found:
        raise KeyError(f"no index {name}")
    return found


def upsert(spark: SparkSession, table: str, entries: DataFrame, key: str) -> None:
    """Last writer wins by key.

    The new table is complete before the old one goes; a run that died in between is finished by the next.
    """
    staged = f"{table}__staged"
    if spark.catalog.tableExists(staged):
        if spark.catalog.tableExists(table):
            spark.sql(f"DROP TABLE {staged}")
        else:
            spark.sql(f"ALTER TABLE {staged} RENAME TO {table}")
    if spark.catalog.tableExists(table):
        old = spark.table(table).join(entries, key, "left_anti")
        entries = old.unionByName(entries, allowMissingColumns=True)
    entries.write.mode("overwrite").saveAsTable(staged)
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    spark.sql(f"ALTER TABLE {staged} RENAME TO {table}")


def load_config(path: str, **names: str) -> dict:
    """A run's settings from JSON, with ``{name}`` slots in strings filled."""

    def fill(x):
        if isinstance(x, dict):
            return {k: fill(v) for k, v in x.items()}
        if isinstance(x, list):
            return [fill(v) for v in x]
        return x.format(**names) if isinstance(x, str) else x

    return fill(json.loads(Path(path).read_text()))


def load_sample(spark: SparkSession, path: str) -> DataFrame:
    """Keys of a query sample, checked against its declared size and SHA-256 of the sorted keys."""
    row = spark.read.schema("n int, sha256 string, query_item_keys array<string>").option("multiLine", True).json(path)
    check = row.select("n", "sha256", F.size("query_item_keys").alias("got"), F.sha2(F.array_join(F.array_sort("query_item_keys"), "\n"), 256).alias("sha")).first()
    if check["n"] != check["got"] or check["sha256"] != check["sha"]:
        raise ValueError("the sample does not match its fingerprint")
    return row.select(F.explode("query_item_keys").alias("item_key"))


def write_report(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path + ".csv")
    df.coalesce(1).write.mode("overwrite").json(path + ".json")


def _few(df: DataFrame, limit: int) -> list:
    """All rows of a report; more than ``limit`` are an error, not a shorter report."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a report of more than {limit} rows: aggregate it first, or write it as a table")
    return rows


def latex_table(df: DataFrame, digits: int = 3, limit: int = 1000) -> str:
    """A small table as LaTeX rows."""
    show = lambda x: f"{x:.{digits}f}" if isinstance(x, float) else "" if x is None else str(x).replace("_", r"\_")
    head = " & ".join(c.replace("_", r"\_") for c in df.columns)
    body = [" & ".join(show(x) for x in r) + r" \\" for r in _few(df, limit)]
    return "\n".join([r"\begin{tabular}{" + "l" * len(df.columns) + "}", head + r" \\", r"\hline", *body, r"\end{tabular}"])


def markdown_table(df: DataFrame, limit: int = 1000) -> str:
    rows = [list(df.columns), ["---"] * len(df.columns), *([("" if x is None else str(x)) for x in r] for r in _few(df, limit))]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows)


def read_latex(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows of a LaTeX table as strings."""
    cells = F.split(F.regexp_replace("value", r"\\\\.*$", ""), r"\s*&\s*")
    rows = spark.read.text(path).where(F.col("value").contains("&")).select(cells.alias("c")).where(F.size("c") == len(columns))
    return rows.select(*(F.trim(F.col("c")[i]).alias(n) for i, n in enumerate(columns)))
