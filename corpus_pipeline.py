"""Corpus pipeline: toxicity, near-duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and
returns a DataFrame that is written as Parquet and read again as the next stage's docs.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrank.llm import decontaminate, neardup, packing, secrets, toxicity
from loomrank.llm.components import remove, shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go; null doc_ids are judged by text like any other."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.score_toxicity(docs, labels).where("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays; rows without a doc_id stay.

    The smallest doc_id of a group stays; where it has several texts in the group, the one of the
    smallest text hash.  A repeated row (equal doc_id and text) is a copy: one of them stays.
    Texts without words are in no group, and texts of one doc_id that are not near-duplicates of each other all stay.
    """
    found = neardup.near_duplicates(docs).where("kept").select("doc_id", "text_key", "group")
    first = found.where("group is not null").groupBy("group").agg(F.min(F.struct("doc_id", "text_key")).alias("x")).select("x.*")
    kept = first.unionByName(found.where("group is null").select("doc_id", "text_key").distinct())
    keyed = docs.withColumn("text_key", F.xxhash64(F.col("text").cast("string")))
    with_id = keyed.where("doc_id is not null").join(kept, ["doc_id", "text_key"], "left_semi").dropDuplicates(["doc_id", "text_key"])
    return with_id.unionByName(keyed.where("doc_id is null")).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go, with or without a doc_id."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.without_contaminated(docs, items).select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Findings are replaced in the text and n_chars follows; every document stays."""
    clean = secrets.redact(docs)
    length = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return clean.withColumn("n_chars", length).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all remaining documents with their places in sequences."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: Classifiers, a network and a genetic search: no SQL gives these rows.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder and read again before the next.

    A stage's table is removed once the next one is written; the last one stays, because the result reads it.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if i:
            remove(spark, f"{folder}/{STAGES[i - 1][0]}")
    return docs
