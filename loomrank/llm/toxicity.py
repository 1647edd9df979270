"""Toxicity by weak supervision.

Voters are cheap and noisy: fixed lexicons, lexicons and word-start lists mined from the
labelled rows of the learning fold (dealt over several voters), and surface patterns.
Their votes on every document are counted by pattern of votes, and a generative label
model is fitted to the counts: each voter has an accuracy in each class, and a tree of
pairwise correlations (the strongest conditional mutual information) keeps voters that
repeat one another from counting twice.  Labelled rows of the fold are clamped.  The
posterior of its pattern is the training label of each sampled document, and a sparse
linear classifier on the mined and listed words and word starts is fitted to those
posteriors.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import checkpointed
from .textkit import map_rows, release

_WORD = re.compile(r"[^\W\d_]+")
_ADDRESSED = re.compile(r"\b(?:you|du|tu|vous|eres|sie)\b[^.!?\n]{0,24}!")

#: Fixed lexicons of plain insults, one voter each.
LEXICONS = {
    "en": "idiot moron stupid dumb loser pathetic worthless scum trash garbage clown disgusting fool jerk filthy vermin",
    "de": "idiot dumm trottel abschaum versager dreck widerlich depp blödmann",
    "fr": "idiot crétin imbécile débile minable ordure abruti nul dégoûtant",
    "es": "idiota imbécil estúpido basura inútil escoria tonto asqueroso payaso",
}
#: Lengths of word starts, and over how many voters each mined list is dealt.
STARTS = (4, 5, 6)
DEALT = 3
#: Labelled rows, and documents to train on, that the models are fitted on (smallest hashes of doc_id).
MAX_LABELLED = 20_000
MAX_TRAIN = 12_000
#: Labelled rows of the label that a mined feature must explain.
LEAST_ROWS = 3
#: A feature marks the label if this share of its rows carries it, by the lower bound at 95 %.
LEAST_PRECISION = 0.5
#: Hashes by which near copies among the labelled rows are told.
SKETCH = 8
_MULTIPLIERS = np.random.default_rng(7).integers(1, 2**61, size=SKETCH, dtype=np.uint64) | np.uint64(1)


def _fold(name: str = "doc_id") -> F.Column:
    return F.pmod(F.crc32(F.col(name).cast("string")), F.lit(4))


def features(text: str | None) -> set[str]:
    """Distinct lower-case words (kind w) and their starts (kinds 4, 5, 6), each prefixed with its kind."""
    ws = set(_WORD.findall(text.lower())) if text else set()
    out = {"w" + w for w in ws}
    for n in STARTS:
        out |= {f"{n}{w[:n]}" for w in ws if len(w) > n}
    return out


def precision_bound(p, q, sqrt=np.sqrt, z: float = 1.96):
    """Wilson lower bound of the share of p in p + q."""
    n = p + q
    return (p + z * z / 2 - z * sqrt(p * q / n + z * z / 4)) / (n + z * z)


def _mine(sample: DataFrame) -> dict[str, int]:
    """Features that mark the label: {feature: voter list number}; ``sample`` has at most MAX_LABELLED rows.

    A feature is chosen if the cover needs it, or if it marks the label by ``LEAST_PRECISION`` with
    each group of near copies counted as one row: copies share all of their words and prove nothing of each.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pos, neg = Counter(), Counter()
            for text, y in zip(pdf["text"], pdf["toxic"]):
                (pos if y else neg).update(features(text))
            keys = list(pos.keys() | neg.keys())
            yield pd.DataFrame({"f": pd.Series(keys, dtype=object), "p": [pos[k] for k in keys], "q": [neg[k] for k in keys]})

    counts = map_rows(sample, run, "f string, p long, q long", ids=()).groupBy("f").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    precise = precision_bound(F.col("p"), F.col("q"), F.sqrt)
    ranked = counts.where(f"f != '' and p >= {LEAST_ROWS}").withColumn("z", precise * F.sqrt("p")).where(precise >= LEAST_PRECISION)
    found = ranked.orderBy(F.desc("z"), "f").collect()
    top = [r["f"] for r in found]
    place = sample.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(top)})

    def marks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [sorted(place.value[f] for f in features(t) & place.value.keys()) for t in pdf["text"]]
            yield pd.DataFrame({"marks": found, "sketch": [sketch(t) for t in pdf["text"]]})

    rows = map_rows(sample.where("toxic = 1"), marks, "marks array<int>, sketch array<long>", ids=()).collect()
    held = [r["marks"] for r in rows]
    kinds = "w" + "".join(map(str, STARTS))
    chosen = {top[i] for kind in kinds for i in cover([[i for i in m if top[i][0] == kind] for m in held], LEAST_ROWS)}
    apart: list[set[int]] = [set() for _ in top]
    for m, group in zip(held, copy_groups([r["sketch"] for r in rows])):
        for i in m:
            apart[i].add(group)
    chosen |= {r["f"] for r, groups in zip(found, apart) if groups and precision_bound(len(groups), r["q"], math.sqrt) >= LEAST_PRECISION}
    return {f: kinds.index(f[0]) * DEALT + zlib.crc32(f.encode()) % DEALT for f in sorted(chosen)}


def sketch(text: str | None) -> list[int]:
    """Smallest of each of SKETCH hashes of the three-word sequences of a text (a shorter text is one); empty without words."""
    ws = _WORD.findall(text.lower()) if text else []
    if not ws:
        return []
    runs = np.array(sorted({zlib.crc32(" ".join(ws[i : i + 3]).encode()) for i in range(max(len(ws) - 2, 1))}), dtype=np.uint64)
    return [int((runs * m >> np.uint64(20)).min()) for m in _MULTIPLIERS]


def copy_groups(sketches: list[list[int]]) -> list[int]:
    """Group number of each sketch; those that agree in any place are together, so texts with a common passage may be too."""
    parent = list(range(len(sketches)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first: dict[tuple[int, int], int] = {}
    for i, values in enumerate(sketches):
        for at in enumerate(values):
            a, b = root(i), root(first.setdefault(at, i))
            parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(sketches))]


def cover(rows: list[list[int]], least: int = LEAST_ROWS) -> list[int]:
    """Greedy cover: the marks that explain the most rows that no earlier mark explains.

    Copies of one labelled text share all of its words; once a real mark explains them,
    their other words explain nothing more and are left out.
    """
    of: dict[int, set[int]] = {}
    for i, marks in enumerate(rows):
        for m in marks:
            of.setdefault(m, set()).add(i)
    chosen, gone = [], set()
    while of:
        best = max(of, key=lambda m: (len(of[m]), -m))
        if len(of[best]) < least:
            break
        chosen.append(best)
        gone = of.pop(best)
        for m in list(of):
            of[m] -= gone
            if len(of[m]) < least:
                del of[m]
    return chosen


class Voters:
    """Bit i of a pattern is the vote of voter i; no bit is an abstention of that voter."""

    def __init__(self, mined: dict[str, int]) -> None:
        self.fixed = [frozenset(v.split()) for v in LEXICONS.values()]
        self.lists: list[set[str]] = [set() for _ in range((1 + len(STARTS)) * DEALT)]
        for f, i in mined.items():
            self.lists[i].add(f)
        self.n = len(self.fixed) + len(self.lists) + 2

    def pattern(self, text: str | None, found: set[str]) -> int:
        bits, i = 0, 0
        for lexicon in self.fixed:
            bits |= any("w" + w in found for w in lexicon) << i
            i += 1
        for listed in self.lists:
            bits |= (not listed.isdisjoint(found)) << i
            i += 1
        if text:
            bits |= bool(_ADDRESSED.search(text)) << i
            bits |= (text.count("!") * 200 > len(text)) << (i + 1)
        return int(bits)


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, clamped: np.ndarray, n_voters: int, rounds: int = 40) -> np.ndarray:
    """Posterior of class 1 of each row, by EM on a tree-augmented generative model.

    counts: unlabelled rows of a pattern; clamped: (rows, 2) labelled rows of it by class,
    which also weigh in directly, against two rows' worth of the model.
    """
    votes = (patterns[:, None] >> np.arange(n_voters)) & 1
    fired = votes.sum(axis=1)
    post = np.clip(fired / 3.0, 0.02, 0.98)
    labelled = clamped.sum(axis=1)
    parent: list[int] | None = None
    for step in range(rounds):
        w1 = counts * post + clamped[:, 1]
        w0 = counts * (1 - post) + clamped[:, 0]
        if step % 5 == 0:
            parent = _tree(votes, np.stack([w0, w1]))
        logp = np.zeros((len(patterns), 2))
        for y, w in enumerate((w0, w1)):
            logp[:, y] = math.log((w.sum() + 1) / (counts.sum() + labelled.sum() + 2))
            for v in range(n_voters):
                given = votes[:, parent[v]] if parent[v] >= 0 else np.zeros(len(votes), int)
                table = np.zeros((2, 2))
                np.add.at(table, (given, votes[:, v]), w)
                table = (table + 0.05) / (table + 0.05).sum(axis=1, keepdims=True)
                logp[:, y] += np.log(table[given, votes[:, v]])
        new = 1 / (1 + np.exp(np.clip(logp[:, 0] - logp[:, 1], -50, 50)))
        moved = np.abs(new - post).max() if len(post) else 0
        post = new
        if moved < 1e-6:
            break
    return (clamped[:, 1] + 2.0 * post) / (labelled + 2.0)


def _tree(votes: np.ndarray, weights: np.ndarray) -> list[int]:
    """Parents in the maximum spanning tree of class-conditional mutual information; -1 at roots and independents."""
    n = votes.shape[1]
    info = np.zeros((n, n))
    total = weights.sum() + 1e-9
    for w in weights:
        mass = w.sum() + 1e-9
        one = (w @ votes) / mass
        both = (votes * w[:, None]).T @ votes / mass
        for a, b in ((1, 1), (1, 0), (0, 1), (0, 0)):
            pa, pb = (one if a else 1 - one), (one if b else 1 - one)
            joint = both if a and b else one[:, None] - both if a else one[None, :] - both if b else 1 - one[:, None] - one[None, :] + both
            joint = np.maximum(joint, 1e-12)
            info += mass / total * joint * np.log(joint / np.maximum(np.outer(pa, pb), 1e-12))
    parent, inside, best = [-1] * n, {0}, info[0].copy()
    near = np.zeros(n, int)
    while len(inside) < n:
        gain = np.where([i in inside for i in range(n)], -np.inf, best)
        v = int(gain.argmax())
        parent[v] = int(near[v]) if best[v] > 1e-4 else -1
        inside.add(v)
        closer = info[v] > best
        near[closer], best[closer] = v, info[v][closer]
    return parent


def fit_linear(rows: list[list[str]], y: np.ndarray, l1: float = 1e-5, rounds: int = 1000) -> tuple[dict[str, float], float]:
    """Sparse logistic regression (FISTA) on presence features and soft labels: (weights, bias).

    Only features that mark the posterior by ``LEAST_PRECISION`` compete.
    """
    df, mass = Counter(), Counter()
    for fs, t in zip(rows, y):
        df.update(fs)
        for f in fs:
            mass[f] += t
    base = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.05
    bias = math.log(base / (1 - base))
    bound = {f: precision_bound(mass[f], n - mass[f]) for f, n in df.items()}
    strong = [f for f, v in bound.items() if v >= LEAST_PRECISION]
    names = sorted(strong, key=lambda f: (-bound[f] * math.sqrt(df[f]), f))
    at = {f: i for i, f in enumerate(names)}
    cols = [np.array([at[f] for f in fs if f in at], dtype=np.int32) for fs in rows]
    idx = np.concatenate(cols) if cols else np.empty(0, np.int32)
    row = np.repeat(np.arange(len(rows)), [len(c) for c in cols])
    if not len(idx):
        return {}, bias
    n, m = len(rows), len(names)
    u = np.ones(m + 1)
    for _ in range(20):
        z = np.bincount(row, weights=u[idx], minlength=n) + u[m]
        u = np.append(np.bincount(idx, weights=z[row], minlength=m), z.sum())
        top = np.sqrt(u @ u)
        u /= top
    step = 4.0 * n / (1.05 * top)
    w, vw, vb, t = np.zeros(m), np.zeros(m), bias, 1.0
    for _ in range(rounds):
        z = np.bincount(row, weights=vw[idx], minlength=n) + vb
        g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / n
        nw = vw - step * np.bincount(idx, weights=g[row], minlength=m)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * l1, 0)
        nb = vb - step * g.sum()
        if ((vw - nw) * (nw - w)).sum() > 0:
            t = 1.0
        nt = (1 + math.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - bias)
        w, bias, t = nw, nb, nt
    return {names[i]: float(w[i]) for i in np.flatnonzero(w)}, float(bias)


def learn(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], float]:
    """The linear model, from labels outside the held-out fold.

    Mined lists are fitted on at most MAX_LABELLED labelled documents and the classifier on at
    most MAX_TRAIN documents (smallest hashes of doc_id); vote patterns count all documents.
    Of several texts of one sampled doc_id the smallest is taken; rows without a doc_id are
    in no fold and only counted.
    """
    spark = docs.sparkSession
    known = labels.where((_fold() != 2) & F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    #: Bounded by MAX_LABELLED and MAX_TRAIN rows.
    sampled = checkpointed(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = text.where((_fold() != 2) & F.col("text").isNotNull()).select("doc_id").distinct()
    train = checkpointed(ids.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(MAX_TRAIN))
    sample = text.join(F.broadcast(sampled), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).drop("doc_id")
    mined = _mine(checkpointed(sample))
    voters = Voters(mined)
    marks = frozenset(mined) | {"w" + w for lexicon in voters.fixed for w in lexicon}
    frozen = spark.sparkContext.broadcast((voters, marks))

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        voters, marks = frozen.value
        for pdf in batches:
            bits, shown = [], []
            for t, chosen in zip(pdf["text"], pdf["chosen"]):
                fs = features(t)
                bits.append(voters.pattern(t, fs))
                shown.append(" ".join(sorted(fs & marks)) if chosen else None)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["y"], "bits": bits, "fs": pd.Series(shown, dtype=object)})

    rows = text.join(F.broadcast(sampled), "doc_id", "left").join(F.broadcast(train.withColumn("chosen", F.lit(True))), "doc_id", "left")
    rows = rows.select("doc_id", "text", F.coalesce("toxic", F.lit(-1)).alias("y"), F.coalesce("chosen", F.lit(False)).alias("chosen"))
    voted = map_rows(rows, vote, "doc_id long, y int, bits long, fs string")
    #: One row for each pattern and label, and one for each sampled document.
    got = voted.groupBy("bits", "y", F.when(F.col("fs").isNotNull(), F.col("doc_id")).alias("doc_id")).agg(F.count("*").alias("n"), F.min("fs").alias("fs"))
    got = checkpointed(got)
    tallied = got.groupBy("bits", "y").agg(F.sum("n").alias("n")).collect()
    rows = got.where("fs is not null").groupBy("doc_id").agg(F.min(F.struct("fs", "bits")).alias("x")).select("x.*").collect()
    patterns = sorted({r["bits"] for r in tallied})
    place = {b: i for i, b in enumerate(patterns)}
    counts, clamped = np.zeros(len(patterns)), np.zeros((len(patterns), 2))
    for r in tallied:
        if r["y"] < 0:
            counts[place[r["bits"]]] += r["n"]
        else:
            clamped[place[r["bits"]], r["y"]] += r["n"]
    post = fit_label_model(np.array(patterns, dtype=np.int64), counts, clamped, voters.n) if patterns else np.empty(0)
    rows.sort()
    y = np.array([post[place[r["bits"]]] for r in rows], dtype=float)
    return fit_linear([r["fs"].split(" ") if r["fs"] else [] for r in rows], y)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (score >= threshold).

    A null or empty text has no features and gets the model's base rate.  Labels that are
    null or neither 0 nor 1 teach nothing; of several labels of a doc_id the highest
    counts.  Without any labels the voters' agreement alone teaches.  Existing columns
    named score or predicted are replaced.  Rows without a doc_id and repeated rows are
    scored each.
    """
    weights, bias = learn(docs, labels)
    model = docs.sparkSession.sparkContext.broadcast((weights, bias))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        release()
        weights, bias = model.value
        keys = weights.keys()
        for texts in batches:
            z = [bias + sum(weights[f] for f in sorted(keys & features(t))) for t in texts]
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -40, 40))), dtype="float64")
        release()

    out = docs.drop("score", "predicted").withColumn("score", score(F.col("text").cast("string")))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op10_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``; folds by crc32 of doc_id, a row without one counts as held out."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held_out = F.coalesce(_fold() == 2, F.lit(True))
    return score_toxicity(docs.select("doc_id", "text"), labels).select("doc_id", held_out.alias("held_out"), "score", "predicted")
