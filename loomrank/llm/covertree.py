"""Embedding near-duplicates: exact cosine threshold pairs by dual cover-tree traversal.

On unit vectors cosine >= c is chord distance <= sqrt(2 - 2c) = eps.  A node is a centre
with a covering radius; a pair of nodes whose centres lie further apart than both radii
plus eps holds no link and is pruned with everything below it, and a pair whose centres and
radii together stay below eps is all links and is counted as a whole.  The tree has two parts:

* the upper levels live in tables: a cell with more than ``cell`` members is split by
  nearest of up to 64 of its own vectors (by hash where that does not part them), and the
  undecided cell pairs are replaced by the pairs of their children, so the traversal itself
  is a join per level;
* below that, sibling cells are sent together, and one task takes all undecided pairs
  between two such blocks: it builds nested levels with halving radii in memory and descends
  both trees at once.

Vectors of equal direction (to the last bit) are one class.  A task returns link counts and a
spanning forest, never the links themselves, so a dense cluster costs output in proportion to
its members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .components import UnionFind, checkpointed, components
from .textkit import map_rows

_FAN = 64
_CHUNK = 4096
#: Sibling cells that are sent to a task together.
_BLOCK = 16
_SLACK = 1e-7


def unit_rows(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(vec_id, root, unit, key): the unit vector as double bytes; nulls where it links with nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            units: list = [None] * len(pdf)
            keys: list = [None] * len(pdf)
            for i, v in enumerate(pdf["v"]):
                x = None if v is None else np.asarray(v, dtype=np.float64)
                if x is None or not len(x) or not np.isfinite(x).all() or not (top := np.abs(x).max()):
                    continue
                x = x / top
                x = x / np.sqrt(x @ x)
                units[i] = x.tobytes()
                keys[i] = xxhash.xxh3_128_digest(units[i])
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "label": pdf["label"], "unit": units, "key": keys})

    src = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.col(label_col).cast("string").alias("label"),
        F.col(vec_col).cast("array<double>").alias("v"),
    )
    out = map_rows(src, run, "vec_id long, label string, unit binary, key binary", ids=("vec_id",))
    root = F.when(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("unit").isNotNull(),
        F.concat_ws("|", "label", F.length("unit"), F.lit("")),
    )
    return out.select("vec_id", root.alias("root"), "unit", "key")


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1)


def _chord(dots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * dots))


class Node:
    """Members ``at`` (indices) within ``radius`` of the centre ``at[0]``."""

    __slots__ = ("at", "children", "radius")

    def __init__(self, at: np.ndarray, radius: float) -> None:
        self.at, self.radius, self.children = at, radius, None

    def split(self, x: np.ndarray) -> list[Node]:
        """Children at half the radius; the first keeps this node's centre (nested levels)."""
        if self.children is None:
            limit, rest, found = self.radius / 2, self.at, []
            while len(rest):
                d = _chord(x[rest] @ x[rest[0]])
                d[0] = 0.0
                near = d <= limit
                found.append(Node(rest[near], float(d[near].max())))
                rest = rest[~near]
            self.children = found
        return self.children


def tree(x: np.ndarray) -> Node:
    d = _chord(x @ x[0])
    d[0] = 0.0
    return Node(np.arange(len(x)), float(d.max()))


def _spread(mask: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest (row, column) of a bipartite link mask."""
    edges, new = [], np.ones(mask.shape[1], bool)
    left = mask.any(axis=1)
    while left.any():
        rows = np.array([int(left.argmax())])
        left[rows] = False
        while len(rows):
            cols = np.zeros(mask.shape[1], bool)
            for r in rows:
                fresh = mask[r] & new
                new &= ~fresh
                cols |= fresh
                edges += [(int(r), int(c)) for c in np.flatnonzero(fresh)]
            hit = np.flatnonzero(left)
            if not cols.any() or not len(hit):
                break
            some = mask[np.ix_(hit, np.flatnonzero(cols))]
            touched = some.any(axis=1)
            edges += [(int(r), int(np.flatnonzero(cols)[c])) for r, c in zip(hit[touched], some[touched].argmax(axis=1))]
            rows = hit[touched]
            left[rows] = False
    return edges


def dual_links(x: np.ndarray, y: np.ndarray | None, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, columns, mask) blocks that hold every pair of cosine >= ``cosine``; y None: x with itself, each pair once."""
    eps = float(np.sqrt(2.0 - 2.0 * cosine)) + _SLACK
    same = y is None
    y = x if same else y
    a = tree(x)
    stack = [(a, a if same else tree(y))]
    while stack:
        p, q = stack.pop()
        ps = p.split(x) if p.radius > 0 else [p]
        qs = ps if q is p else q.split(y) if q.radius > 0 else [q]
        pc, qc = np.array([n.at[0] for n in ps]), np.array([n.at[0] for n in qs])
        pr, qr = np.array([n.radius for n in ps]), np.array([n.radius for n in qs])
        dots = x[pc] @ y[qc].T
        near = _chord(dots) <= pr[:, None] + qr[None, :] + eps
        if q is p:
            near = np.triu(near)
        whole = (pr == 0)[:, None] & (qr == 0)[None, :]
        flat = near & whole
        if flat.any():
            sp = np.array([len(n.at) for n in ps])
            sq = np.array([len(n.at) for n in qs])
            one = flat & (sp == 1)[:, None] & (sq == 1)[None, :]
            if q is p:
                np.fill_diagonal(one, False)
            one &= dots >= cosine
            if one.any():
                yield pc, qc, one
            for i, j in zip(*np.nonzero(flat & ~((sp == 1)[:, None] & (sq == 1)[None, :]))):
                mask = x[ps[i].at] @ y[qs[j].at].T >= cosine
                if ps[i] is qs[j]:
                    mask = np.triu(mask, 1)
                if mask.any():
                    yield ps[i].at, qs[j].at, mask
        for i, j in zip(*np.nonzero(near & ~whole)):
            stack.append((ps[i], qs[j]))


def _leaf(cosine: float):
    """Links between the cells of two blocks (or of one), for the listed cell pairs only."""

    def run(members: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        cells = {c: (_matrix(g["unit"]), g["id"].to_numpy(), g["n"].to_numpy(), np.zeros(len(g), np.int64)) for c, g in members.groupby("cell")}
        uf = UnionFind()
        for a, b in zip(pairs["a"], pairs["b"]):
            (x, left, n_left, c_left), (y, right, n_right, c_right) = cells[a], cells[b]
            for rows, cols, mask in dual_links(x, None if a == b else y, cosine):
                np.add.at(c_left, rows, mask @ n_right[cols])
                np.add.at(c_right, cols, n_left[rows] @ mask)
                for r, c in _spread(mask):
                    uf.union(int(left[rows[r]]), int(right[cols[c]]))
        found = [(int(ids[i]), int(count[i]), None) for _, ids, _, count in cells.values() for i in np.flatnonzero(count)]
        found += [(v, 0, r) for v in uf.parent if (r := uf.find(v)) != v]
        out = pd.DataFrame(found, columns=["id", "links", "peer"])
        return out.astype({"id": "int64", "links": "int64", "peer": "Int64"})

    return run


def _assign(members: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
    if not len(members):
        return pd.DataFrame({c: [] for c in ("cell", "id", "n", "unit", "parent", "center", "dist")})
    pivots = pivots.sort_values("rn")
    x, p = _matrix(members["unit"]), _matrix(pivots["punit"])
    dots = x @ p.T
    best = dots.argmax(axis=1)
    cell = members["cell"].iloc[0]
    return pd.DataFrame(
        {
            "cell": [f"{cell}.{i}" for i in best],
            "id": members["id"].values,
            "n": members["n"].values,
            "unit": members["unit"].values,
            "parent": cell,
            "center": pivots["punit"].to_numpy()[best],
            "dist": _chord(dots[np.arange(len(x)), best]),
        }
    )


def _decide(eps: float):
    """(a, b, whole) of the pairs that are not pruned; whole: every member of a links to every one of b."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            known = (pdf["ca"].notna() & pdf["cb"].notna()).to_numpy()
            keep, whole = np.ones(len(pdf), bool), np.zeros(len(pdf), bool)
            size = pdf["ca"].str.len().fillna(0).to_numpy()
            same = (pdf["a"] == pdf["b"]).to_numpy()
            for n in np.unique(size[known]):
                rows = np.flatnonzero(known & (size == n))
                a, b = _matrix(pdf["ca"].iloc[rows]), _matrix(pdf["cb"].iloc[rows])
                d = np.where(same[rows], 0.0, _chord(np.einsum("ij,ij->i", a, b)))
                reach = pdf["ra"].to_numpy()[rows] + pdf["rb"].to_numpy()[rows]
                keep[rows] = d <= reach + eps + _SLACK
                #: Chords of nearly equal vectors are only known to about 1e-8.
                whole[rows] = d + reach <= eps - 1e-6
            yield pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "whole": whole})[keep]

    return run


def threshold_links(classes: DataFrame, cosine: float, cell: int = 2048) -> DataFrame:
    """(id, links, peer) rows from classes(root, id, n, unit): link counts, and forest edges where peer is set."""
    eps = float(np.sqrt(2.0 - 2.0 * cosine))
    members = classes.select(F.col("root").alias("cell"), "id", "n", "unit")
    roots = members.select("cell").distinct()
    pairs = roots.select(F.col("cell").alias("a"), F.col("cell").alias("b"))
    geometry = roots.select("cell", F.lit(None).cast("binary").alias("center"), F.lit(None).cast("double").alias("radius"))
    found: list[DataFrame] = []
    while True:
        big = checkpointed(members.groupBy("cell").count().where(F.col("count") > cell))
        if big.isEmpty():
            break
        by = W.partitionBy("cell").orderBy(F.xxhash64("id"), "id")
        k = F.least(F.lit(_FAN), 2 * F.ceil(F.col("count") / cell))
        pivots = members.join(big.select("cell"), "cell", "left_semi").withColumn("rn", F.row_number().over(by))
        pivots = pivots.where(f"rn <= {_FAN}").join(big, "cell").where(F.col("rn") <= k)
        parts = F.ceil(F.col("count") / _CHUNK).cast("int")
        pivots = pivots.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
        pivots = pivots.select(F.col("cell").alias("pcell"), F.col("part").alias("ppart"), "rn", F.col("unit").alias("punit"))
        moving = members.join(big, "cell").withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int"))
        moved = (
            moving.select("cell", "part", "id", "n", "unit")
            .groupBy("cell", "part")
            .cogroup(pivots.groupBy("pcell", "ppart"))
            .applyInPandas(_assign, "cell string, id long, n long, unit binary, parent string, center binary, dist double")
        )
        moved = checkpointed(moved)
        #: A child with more than nine tenths of a cell was not parted by distance: it is dealt by hash, about one centre.
        sizes = moved.groupBy("cell", "parent").count().withColumnRenamed("count", "held").join(big.withColumnRenamed("cell", "parent"), "parent")
        stuck = sizes.where(F.col("held") > 0.9 * F.col("count")).select("cell", F.ceil(2 * F.col("held") / cell).cast("int").alias("deal"))
        dealt = F.concat_ws(".", "cell", F.concat(F.lit("h"), F.pmod(F.xxhash64("id"), F.col("deal")).cast("string")))
        moved = moved.join(stuck, "cell", "left").withColumn("cell", F.when(F.col("deal").isNull(), F.col("cell")).otherwise(dealt)).drop("deal")
        moved = checkpointed(moved)
        split = moved.groupBy("cell").agg(F.first("parent").alias("parent"), F.first("center").alias("center"), F.max("dist").alias("radius"))
        kept = geometry.join(big.select("cell"), "cell", "left_anti").select("cell", F.col("cell").alias("parent"), "center", "radius")
        children = checkpointed(split.unionByName(kept))
        geometry = children.select("cell", "center", "radius")
        sides = [
            children.select(
                F.col("parent").alias("p" + s), F.col("cell").alias("n" + s), F.col("center").alias("c" + s), F.col("radius").alias("r" + s)
            )
            for s in "ab"
        ]
        finer = pairs.join(sides[0], F.col("a") == F.col("pa")).join(sides[1], F.col("b") == F.col("pb"))
        finer = finer.where("a != b or na <= nb").select(F.col("na").alias("a"), F.col("nb").alias("b"), "ca", "cb", "ra", "rb")
        decided = checkpointed(map_rows(finer, _decide(eps), "a string, b string, whole boolean", ids=()))
        members = members.join(big.select("cell"), "cell", "left_anti").unionByName(moved.select("cell", "id", "n", "unit"))
        members = checkpointed(members)
        found.append(_whole_pairs(decided.where("whole"), members))
        pairs = decided.where("not whole").select("a", "b")
    block = F.regexp_extract("cell", r"(?s)^(.*?)(?:\.h?(\d+))?$", 1), F.regexp_extract("cell", r"(?s)^(.*?)(?:\.h?(\d+))?$", 2)
    of_cell = F.concat_ws("/", block[0], F.floor(F.coalesce(block[1].try_cast("int"), F.lit(0)) / _BLOCK).cast("string"))
    blocks = members.select("cell").distinct().withColumn("block", of_cell)
    placed = pairs.join(blocks.select(F.col("cell").alias("a"), F.col("block").alias("ba")), "a").join(blocks.select(F.col("cell").alias("b"), F.col("block").alias("bb")), "b")
    placed = checkpointed(placed.select("a", "b", F.least("ba", "bb").alias("x"), F.greatest("ba", "bb").alias("y")))
    ends = placed.select("x", "y", F.col("a").alias("cell")).union(placed.select("x", "y", F.col("b").alias("cell"))).distinct()
    asked = placed.select("a", "b", F.col("x").alias("px"), F.col("y").alias("py"))
    sent = ends.join(members, "cell").groupBy("x", "y").cogroup(asked.groupBy("px", "py"))
    out = sent.applyInPandas(_leaf(cosine), "id long, links long, peer long")
    for more in found:
        out = out.unionByName(more)
    return out


def _whole_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(id, links, peer) for cell pairs of which all members link: counts by cell, and one edge a member and pair of cells."""
    size = members.groupBy("cell").agg(F.sum("n").alias("size"), F.min("id").alias("anchor"))
    both = pairs.join(size.withColumnsRenamed({"cell": "a", "size": "na", "anchor": "xa"}), "a").join(size.withColumnsRenamed({"cell": "b", "size": "nb", "anchor": "xb"}), "b")
    both = checkpointed(both.select("a", "b", "na", "nb", "xa", "xb"))
    gains = both.select(F.col("a").alias("cell"), F.col("nb").alias("gain"), (F.col("a") == F.col("b")).alias("own"))
    gains = gains.unionByName(both.where("a != b").select(F.col("b").alias("cell"), F.col("na").alias("gain"), F.lit(False).alias("own")))
    gains = gains.groupBy("cell").agg(F.sum("gain").alias("gain"), F.bool_or("own").alias("own"))
    counted = members.join(gains, "cell").join(size.select("cell", "anchor"), "cell")
    #: A member's own copies are counted apart.
    links = counted.select("id", (F.col("gain") - F.when(F.col("own"), F.col("n")).otherwise(0)).alias("links"), F.when(F.col("id") != F.col("anchor"), F.col("anchor")).alias("peer"))
    joined = both.where("xa != xb").select(F.greatest("xa", "xb").alias("id"), F.lit(0).cast("long").alias("links"), F.least("xa", "xb").alias("peer"))
    return links.unionByName(joined)


def embedding_neardup(
    vectors: DataFrame,
    cosine: float = 0.93,
    cell: int = 2048,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per vector.

    Vectors of equal, non-null label and equal length are compared in double precision and
    link at a cosine of at least ``cosine``.  Vectors that are null, empty, zero or hold null
    or non-finite components, and those without a label, link with nothing: n_links 0 and
    their own component.  A null vec_id links with nothing and gets a null component_id and
    kept.  Repeated rows are vectors of their own, linked with their copies.
    """
    rows = checkpointed(unit_rows(vectors, id_col, vec_col, label_col))
    live = rows.where("root is not null")
    classes = live.groupBy("root", "key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("unit").alias("unit"))
    #: A class has a number of its own: its smallest vec_id may be that of another class too.
    classes = checkpointed(classes.withColumn("id", F.monotonically_increasing_id()))
    found = checkpointed(threshold_links(classes, cosine, cell))
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    comp = components(found.where("peer is not null").select(F.col("id").alias("a"), F.col("peer").alias("b")))
    placed = classes.select("root", "key", "id", "rep", "n").join(counts, "id", "left").join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    least = placed.groupBy("comp").agg(F.min("rep").alias("component_id"))
    of_class = placed.join(least, "comp").select("root", "key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    own = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return rows.join(of_class, ["root", "key"], "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        own.alias("component_id"),
        (F.col("vec_id") == own).alias("kept"),
    )


def op2_covertree_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``embeddings`` at a cosine of 0.93 within equal labels."""
    return embedding_neardup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP2_SQL = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), pairs AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach(id, r) AS (
    SELECT vec_id, vec_id FROM v UNION SELECT p.a, reach.r FROM reach JOIN pairs p ON p.b = reach.id
), comp AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id),
links AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN comp ON comp.id = v.vec_id LEFT JOIN links ON links.a = v.vec_id
"""
