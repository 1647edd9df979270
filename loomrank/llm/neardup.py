"""MinHash near-duplicates: SuperMinHash signatures, banding, verification, union-find.

A text's set is its distinct k-word shingles as 64-bit hashes.  Texts with equal sets
form a class (128-bit key); only one signature per class is banded.  SuperMinHash
draws, for each element, a random permutation of the m slots and ranks j + u_j along
it; the slots of an element are thus correlated, which lowers the variance, and a
document stops as soon as every slot holds a value below the next rank.  Slots are cut
into bands whose length follows from the threshold so that a pair at the threshold is
missed with probability under ``miss``.

Candidates never form all pairs of a bucket: every class is first compared with the
smallest class of each of its buckets (a star), and the links found are grouped.  Only
buckets that still hold classes of several groups need more: their classes meet in blocks
of bounded size, cut by set size, where a matrix product counts all intersections at once
and a union-find returns a forest instead of the links.  Every link is confirmed on the
full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import UnionFind, checkpointed, components
from .textkit import U64, map_rows, mix64, seed64, shingle_hashes, to_long

#: Elements whose permutations are held at once (times slots bytes of memory).
_CHUNK = 1 << 15
#: Most classes, and most shingles, of a block of the comparison between groups.
BLOCK_CLASSES, BLOCK_SHINGLES = 1024, 200_000
#: Members of a star that are verified in one task; larger stars are split and their centre is copied.
STAR_MEMBERS = 2048


def band_shape(threshold: float, slots: int = 128, miss: float = 1e-6) -> tuple[int, int]:
    """(bands, rows): the longest bands that miss a pair at the threshold with at most ``miss``."""
    for rows in range(slots, 0, -1):
        bands = slots // rows
        if (1 - threshold**rows) ** bands <= miss:
            return bands, rows
    raise ValueError("no band length reaches the threshold; raise slots")


def _unit(h: np.ndarray, j: int, which: int) -> np.ndarray:
    return (mix64(h + seed64(2 * j + which)) >> U64(11)).astype(np.float64) * (1.0 / (1 << 53))


def superminhash(sets: list[np.ndarray], slots: int = 128) -> np.ndarray:
    """Signatures (len(sets), slots) of non-empty hash sets."""
    out = np.full((len(sets), slots), np.inf)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    cuts, start, total = [0], 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > _CHUNK:
            cuts.append(i)
            total = 0
        total += n
    cuts.append(len(sets))
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        if lo == hi:
            continue
        h = np.concatenate(sets[lo:hi])
        doc = np.repeat(np.arange(lo, hi), sizes[lo:hi])
        perm = None
        for j in range(slots):
            k = j + (_unit(h, j, 1) * (slots - j)).astype(np.int64)
            if perm is None:
                pos = k
            else:
                row = np.arange(len(h))
                pos = perm[row, k]
                perm[row, k] = perm[:, j]
            np.minimum.at(out.reshape(-1), doc * slots + pos, _unit(h, j, 0) + j)
            open_ = out[lo:hi].max(axis=1) >= j + 1
            live = open_[doc - lo]
            if not live.any():
                break
            if perm is None:
                h, doc, pos = h[live], doc[live], pos[live]
                perm = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.int32), (len(h), 1))
                row = np.arange(len(h))
                perm[row, pos] = 0
            elif not live.all():
                h, doc, perm = h[live], doc[live], perm[live]
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band, the band's number included."""
    bits = sig.view(U64)
    keys = np.empty((len(sig), bands), U64)
    for b in range(bands):
        acc = np.full(len(sig), seed64(5000 + b), U64)
        for i in range(rows):
            acc = mix64(acc ^ bits[:, b * rows + i]) + seed64(i)
        keys[:, b] = acc
    return keys


def signatures(docs: DataFrame, k: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_key, n_shingles, set_key, bands) per row; set_key and bands are null for empty sets."""
    slots = bands * rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [shingle_hashes(t, k) for t in pdf["text"]]
            full = [i for i, s in enumerate(sets) if len(s)]
            keys: list = [None] * len(sets)
            found: list = [None] * len(sets)
            if full:
                got = to_long(band_keys(superminhash([sets[i] for i in full], slots), bands, rows))
                for i, row in zip(full, got):
                    keys[i] = xxhash.xxh3_128_digest(sets[i].tobytes())
                    found[i] = row
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text_key": pdf["text_key"], "n_shingles": [len(s) for s in sets], "set_key": keys, "bands": found})

    text = F.col(text_col).cast("string")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    return map_rows(src, run, "doc_id long, text_key long, n_shingles long, set_key binary, bands array<long>", rows=512)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets satisfy 100 * intersection >= percent * union.

    Many a share one b: a b of more than STAR_MEMBERS pairs is split over tasks, each with a copy of its set.
    """
    parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / STAR_MEMBERS).cast("int").alias("parts"))
    left = sets.select(F.col("id").alias("a"), F.col("s").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("s").alias("sb")).join(parts, "b")
    right = right.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    split = pairs.join(parts, "b").withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int")).drop("parts")
    both = F.size(F.array_intersect("sa", "sb"))
    return (
        split.join(left, "a")
        .join(right, ["b", "part"])
        .withColumn("n", both)
        .where(100 * F.col("n") >= percent * (F.size("sa") + F.size("sb") - F.col("n")))
        .select("a", "b")
    )


def _between_blocks(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b), as a forest per task, between all classes of ``rest(rep, n, pivot)`` whose buckets touch.

    Classes connected through buckets are a field.  Sets of sizes that differ by more than the
    threshold allows cannot link, so a field is cut by size into steps of that ratio, a step
    into blocks of bounded size, and only blocks of the same or the next step meet.
    """
    fields = components(rest.select(F.col("rep").alias("a"), F.col("pivot").alias("b")))
    step = F.floor(F.log("n") / math.log(100 / percent + 1e-6)).cast("int")
    rows = rest.select("rep", "n").distinct().join(fields.withColumnRenamed("id", "rep"), "rep")
    rows = rows.select("rep", "n", F.col("comp").alias("field"), step.alias("step"))
    parts = F.greatest(F.ceil(F.count("*") / BLOCK_CLASSES), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    counts = rows.groupBy("field", "step").agg(parts.alias("parts"))
    rows = checkpointed(
        rows.join(counts, ["field", "step"]).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    )
    near = counts.select(
        "field", F.explode(F.array(*(F.col("step") + d for d in (-1, 0, 1)))).alias("step"), F.col("step").alias("other"), F.col("parts").alias("others")
    )
    met = rows.join(near, ["field", "step"]).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    own, other = F.struct("step", "part"), F.struct(F.col("other").alias("step"), F.col("q").alias("part"))
    met = met.select("rep", "field", F.least(own, other).alias("x"), F.greatest(own, other).alias("y"), (own > other).cast("int").alias("side"))
    met = met.join(sets.withColumnRenamed("id", "rep"), "rep")
    return met.groupBy("field", "x", "y").applyInPandas(_block_links(percent), "a long, b long")


def _block_links(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, side = pdf["rep"].to_numpy(), pdf["side"].to_numpy()
        sizes = np.array([len(s) for s in pdf["s"]])
        _, at, times = np.unique(np.concatenate(pdf["s"].to_numpy()), return_inverse=True, return_counts=True)
        doc = np.repeat(np.arange(len(ids)), sizes)
        common = times[at] > 1
        at, doc = np.unique(at[common], return_inverse=True)[1], doc[common]
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1) if side.any() else left
        both = np.zeros((len(left), len(right)), np.float32)
        order = np.argsort(at, kind="stable")
        at, doc = at[order], doc[order]
        for lo in range(0, int(at[-1]) + 1 if len(at) else 0, 4096):
            cut = slice(*np.searchsorted(at, (lo, lo + 4096)))
            bits = np.zeros((len(ids), 4096), np.float32)
            bits[doc[cut], at[cut] - lo] = 1
            both += bits[left] @ bits[right].T
        link = 100 * both >= percent * (sizes[left][:, None] + sizes[right][None, :] - both)
        uf = UnionFind()
        for r, c in zip(*np.nonzero(link)):
            uf.union(int(ids[left[r]]), int(ids[right[c]]))
        found = [(x, uf.find(x)) for x in uf.parent if uf.find(x) != x]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def near_duplicates(
    docs: DataFrame,
    k: int = 5,
    percent: int = 80,
    slots: int = 128,
    miss: float = 1e-6,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_key, group), one row per input row.

    Two texts link if 100 * intersection >= percent * union of their k-word shingle
    sets; component_id is the smallest doc_id reachable by links.  Null, empty and blank
    texts have an empty set, link with nothing and are their own component.  Rows with a
    null doc_id link with nothing and get a null component_id and kept.  Repeated rows
    are copies of one another and each is returned; different texts of one doc_id are
    documents of their own.  Other columns of ``docs`` are not read.

    text_key is a hash of the text and group numbers the component (null where the row links
    with nothing by rule); the numbers differ from run to run.
    """
    bands, rows = band_shape(percent / 100, slots, miss)
    sig = checkpointed(signatures(docs, k, bands, rows, id_col, text_col))
    live = sig.where("set_key is not null and doc_id is not null")
    classes = live.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    #: A class has a number of its own: its smallest doc_id may be that of another class too.
    classes = checkpointed(classes.withColumn("id", F.monotonically_increasing_id()))
    entries = classes.select("id", "n", F.explode("bands").alias("key"))
    buckets = entries.groupBy("key").agg(F.min(F.struct("id", "n")).alias("p"), F.count("*").alias("m")).where("m > 1")
    shared = checkpointed(entries.join(buckets.select("key", "p"), "key"))
    #: Sizes bound the similarity: the smaller set must hold percent of the larger one.
    fits = "100 * least({0}, {1}) >= {2} * greatest({0}, {1})"
    stars = shared.where("id != p.id").where(fits.format("n", "p.n", percent)).select(F.col("id").alias("a"), F.col("p.id").alias("b")).distinct()
    stars = checkpointed(stars)
    hashed = set_table(docs, shared.select("id").distinct(), k, id_col, text_col, classes)
    links = checkpointed(_verified(stars, hashed, percent))
    comp = checkpointed(components(links))
    grouped = shared.join(comp, "id", "left").select("key", F.coalesce("comp", "id").alias("comp"))
    mixed = grouped.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("key")
    rest = checkpointed(shared.join(mixed, "key").select(F.col("id").alias("rep"), "n", F.col("p.id").alias("pivot")).distinct())
    if not rest.isEmpty():
        more = checkpointed(_between_blocks(rest, hashed, percent))
        comp = checkpointed(components(comp.select(F.col("id").alias("a"), F.col("comp").alias("b")).union(more)))
    placed = classes.join(comp, "id", "left").select("set_key", "rep", F.coalesce("comp", "id").alias("group"))
    least = placed.groupBy("group").agg(F.min("rep").alias("component_id"))
    of_class = placed.join(least, "group").select("set_key", "group", "component_id")
    out = sig.select("doc_id", "n_shingles", "set_key", "text_key").join(of_class, "set_key", "left")
    known = F.col("doc_id").isNotNull()
    own = F.when(known, F.coalesce("component_id", "doc_id"))
    return out.select(
        "doc_id", "n_shingles", own.alias("component_id"), (F.col("doc_id") == own).alias("kept"), "text_key", F.when(known, F.col("group")).alias("group")
    )


def set_table(docs: DataFrame, ids: DataFrame, k: int, id_col: str, text_col: str, classes: DataFrame) -> DataFrame:
    """(id, s): the full shingle sets of the listed classes.

    Only the texts of classes that share a bucket are hashed again; ``classes`` gives the
    set key to pick the right row where a doc_id is repeated.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [to_long(shingle_hashes(t, k)) for t in pdf["text"]]
            keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            good = [x == y for x, y in zip(keys, pdf["set_key"])]
            yield pd.DataFrame({"id": pdf["id"], "s": sets})[good]

    wanted = classes.select("id", F.col("rep").alias("doc"), "set_key").join(ids, "id", "left_semi")
    src = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    found = map_rows(src.join(wanted, "doc").drop("doc"), run, "id long, s array<long>", ids=("id",), rows=512)
    return checkpointed(found.groupBy("id").agg(F.first("s").alias("s")))


def op3_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` at three words and a similarity of 0.85."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")
