"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are partitioned by the size of their shingle set (powers of two).  The
MinHash sketch of an item is its bottom-k shingles in hash order, a sample of the set
without replacement; k is one number for each size partition.  A document that holds at
least need = ceil(percent * n) of an item's n shingles lacks at most n - need of them, so it
holds at least k - (n - need) of the sketch.  With k = hi - ceil(percent * hi) + 1 for the
largest size hi of the partition that is one at least, for every size of the partition:
documents that hold too little of a sketch, however long they are, are left out without
missing one, and each candidate is verified by exact containment of shingle sets.

Items are the query side.  Up to ``block_shingles`` shingles of items are held in memory
and meet all documents in one scan without a shuffle; a larger set of items is searched by
joins on sketch values, with nothing broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import checkpointed
from .textkit import U64, map_rows, release, shingle_hashes, to_long, window_hashes, word_hashes, words

SHINGLE = 5
PERCENT = 80
BLOCK_SHINGLES = 2_000_000


def least_shared(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def sketch_length(n: int, percent: int) -> int:
    """k for an item of n shingles, from the largest size of its size partition."""
    hi = (1 << n.bit_length()) - 1
    return min(n, hi - least_shared(hi, percent) + 1)


def item_sets(items: DataFrame, k: int, item_col: str, text_col: str) -> DataFrame:
    """(item_id, n, s): the distinct shingle sets of items that have an id and words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [to_long(shingle_hashes(t, k)) for t in pdf["text"]]
            out = pd.DataFrame({"item_id": pdf["item_id"], "n": [len(s) for s in sets], "s": sets})
            yield out[(out["n"] > 0) & out["item_id"].notna()]

    src = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    return map_rows(src, run, "item_id long, n long, s array<long>", ids=("item_id",)).distinct()


class Index:
    """Sketch values to items, and the full sets to verify with."""

    def __init__(self, rows: list, percent: int) -> None:
        self.ids = [int(r["item_id"]) for r in rows]
        self.sets = [np.array(r["s"], dtype=np.int64).view(U64) for r in rows]
        self.need = [least_shared(len(s), percent) for s in self.sets]
        sketches = [s[: sketch_length(len(s), percent)] for s in self.sets]
        #: Sketch values that a document must hold.
        self.least = np.array([len(k) - (len(s) - n) for k, s, n in zip(sketches, self.sets, self.need)], np.int64)
        owner = np.repeat(np.arange(len(rows)), [len(s) for s in sketches])
        values = np.concatenate(sketches) if sketches else np.empty(0, U64)
        order = np.argsort(values, kind="stable")
        self.values, self.owner = values[order], owner[order]
        self.keys, first = np.unique(self.values, return_index=True)
        self.span = np.append(first, len(self.values))

    def search(self, shingles: np.ndarray) -> list[tuple[int, int, int]]:
        """(item_id, shared, n) of the items that a document's shingles (any order, repeats allowed) contain."""
        if not len(self.keys) or not len(shingles):
            return []
        at = np.searchsorted(self.keys, shingles)
        at[at == len(self.keys)] = 0
        hit = np.unique(at[self.keys[at] == shingles])
        if not len(hit):
            return []
        own = np.unique(shingles)
        found = []
        items, held = np.unique(np.concatenate([self.owner[self.span[h] : self.span[h + 1]] for h in hit]), return_counts=True)
        for i in items[held >= self.least[items]]:
            s = self.sets[i]
            pos = np.searchsorted(own, s)
            pos[pos == len(own)] = 0
            shared = int((own[pos] == s).sum())
            if shared >= self.need[i]:
                found.append((self.ids[i], shared, len(s)))
        return found


def _item_table(items: DataFrame, k: int, item_col: str, item_text_col: str) -> tuple[DataFrame, int]:
    sets = checkpointed(item_sets(items, k, item_col, item_text_col))
    return sets, sets.agg(F.sum("n")).first()[0] or 0


def _document_hashes(text: str | None, k: int) -> np.ndarray:
    h = word_hashes(words(text))
    return window_hashes(h, min(k, len(h)), k)


def _searched(src: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item) by one scan with all item sets in memory."""
    shared_index = src.sparkSession.sparkContext.broadcast(Index(sets.select("item_id", "s").collect(), percent))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = shared_index.value
        for pdf in batches:
            found = [(i, *hit) for i, text in enumerate(pdf["text"]) for hit in index.search(_document_hashes(text, k))]
            at, item, shared, n = np.array(found, np.int64).reshape(-1, 4).T
            yield pd.DataFrame({"doc_id": pdf["doc_id"].array.take(at), "item_id": item, "n_shared": shared, "n_item": n})

    return map_rows(src, run, "doc_id long, item_id long, n_shared long, n_item long")


def _joined(src: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """The same by joins: documents' shingles meet sketch values, candidates meet their full sets.

    A sketch value that many documents hold (a shared line) is one row of the items' side for
    each item, and the join is a sort-merge join, which adaptive execution splits.
    """

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [to_long(np.unique(_document_hashes(t, k))) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "own": sets})

    docs = checkpointed(map_rows(src, hashed, "doc_id long, own array<long>").where(F.size("own") > 0).withColumn("row", F.monotonically_increasing_id()))
    least = lambda n: F.expr(f"({percent} * {n} + 99) div 100")
    sized = sets.withColumn("hi", F.expr("shiftleft(1L, length(bin(n))) - 1")).withColumn("need", least("n"))
    sized = sized.withColumn("k", F.least("n", F.col("hi") - least("hi") + 1).cast("int"))
    #: An item id may have several sets.
    items = checkpointed(sized.withColumn("item", F.monotonically_increasing_id()))
    #: Sets are sorted as unsigned numbers, the order of the sketch.
    sketch = items.select("item", (F.col("k") - (F.col("n") - F.col("need"))).alias("least"), F.explode(F.slice("s", F.lit(1), F.col("k"))).alias("h"))
    hits = docs.select("row", F.explode("own").alias("h")).join(sketch, "h").groupBy("row", "item").agg(F.count("*").alias("held"), F.first("least").alias("least"))
    pairs = hits.where("held >= least").select("row", "item").join(items, "item").join(docs, "row")
    shared = F.size(F.array_intersect("own", "s")).cast("long")
    return pairs.select("doc_id", "item_id", shared.alias("n_shared"), F.col("n").alias("n_item"), "need").where("n_shared >= need").drop("need")


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    k: int = SHINGLE,
    percent: int = PERCENT,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item): items of which a document holds at least ``percent`` percent.

    Sets are distinct k-word shingles; a text of fewer words is one shingle, its whole
    sequence, so a shorter item matches only a text that equals it.  Null, empty and blank
    texts match nothing; neither do items with a null id.  Rows with a null doc_id are
    searched and returned with a null doc_id.  A repeated document row gives repeated
    results; repeated item rows (equal id and set) count once.  Other columns are not read.
    """
    sets, total = _item_table(items, k, item_col, item_text_col)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return (_searched if total <= block_shingles else _joined)(src, sets, k, percent)


def without_contaminated(docs: DataFrame, items: DataFrame, k: int = SHINGLE, percent: int = PERCENT, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) whose text contains no item; judged by text alone, so a null doc_id changes nothing."""
    sets, total = _item_table(items, k, "item_id", "text")
    if total > block_shingles:
        key = F.xxhash64(F.col("text").cast("string"))
        src = docs.select(key.alias("doc_id"), F.col("text").cast("string").alias("text"))
        hit = _joined(src, sets, k, percent).select(F.col("doc_id").alias("text_key")).distinct()
        return docs.withColumn("text_key", key).join(hit, "text_key", "left_anti").drop("text_key")
    shared_index = docs.sparkSession.sparkContext.broadcast(Index(sets.select("item_id", "s").collect(), percent))

    @F.pandas_udf("boolean")
    def contains(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        release()
        index = shared_index.value
        for texts in batches:
            yield pd.Series([bool(index.search(_document_hashes(t, k))) for t in texts], dtype=bool)
        release()

    return docs.where(~contains(F.col("text").cast("string")))


def op5_containment_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ``benchmark`` item against all whole ``documents``."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contained_items(docs, items)


OP5_SQL = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), b AS (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM benchmark
), di AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0),
bi AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM b WHERE len(w) > 0),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM di),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s FROM bi),
n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS n_shared, any_value(n_item) AS n_item
FROM ds JOIN bs USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id HAVING 100 * count(*) >= 80 * any_value(n_item)
"""
