"""Language identification with hyperdimensional letter n-gram profiles.

Every letter has a random bipolar vector drawn from its code point.  A letter n-gram is
bound by multiplying its letters' vectors, each rotated by its place, and a text is the
bundle (sum) of its n-grams.  A language's prototype bundles the texts of its learning
fold; a text is compared with the prototypes by cosine.  Because a bundle is a sum, the
learning pass only counts n-grams by language, and the counts are bundled afterwards.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import CACHES, map_rows

DIM = 1024
ORDER = 3
#: n-gram vectors kept by a task; others are bound again when they occur.
_CACHE = 12_000
MAX_LANGUAGES = 4096
_SEED = 0x5EED


class Letters:
    """Letters by code point (Unicode's L categories): 0 ends a word, others are the letter's code."""

    def __init__(self) -> None:
        self.codes = np.fromiter((c if unicodedata.category(chr(c))[0] == "L" else 0 for c in range(0x110000)), np.uint32, 0x110000)

    def grams(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams (ORDER code points of 21 bits in a uint64) of the lower-cased text, and their counts."""
        if not text:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        x = self.codes[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
        x = np.concatenate(([0], x, [0])).astype(np.uint64)
        x = x[(x != 0) | np.r_[True, x[:-1] != 0]]
        if len(x) < ORDER:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        n = len(x) - ORDER + 1
        g = np.zeros(n, np.uint64)
        for i in range(ORDER):
            g = (g << np.uint64(21)) | x[i : i + n]
        return np.unique(g, return_counts=True)


def letters_of_worker() -> Letters:
    """The worker's table of letters, kept from task to task."""
    if "letters" not in CACHES:
        CACHES["letters"] = Letters()
    return CACHES["letters"]


class Space:
    """Bound n-gram vectors, made on demand and cached up to a bound."""

    def __init__(self, dim: int = DIM) -> None:
        self.dim = dim
        self.letters: dict[int, np.ndarray] = {}
        self.at: dict[int, int] = {}
        self.rows = np.empty((_CACHE, dim), np.int8)

    def letter(self, code: int) -> np.ndarray:
        v = self.letters.get(code)
        if v is None:
            bits = np.random.default_rng((_SEED, code)).integers(0, 2, self.dim, dtype=np.int8)
            v = self.letters[code] = (2 * bits - 1).astype(np.int8)
        return v

    def bind(self, gram: int) -> np.ndarray:
        out = np.ones(self.dim, np.int8)
        for place in range(ORDER):
            out = out * np.roll(self.letter((gram >> (21 * place)) & 0x1FFFFF), place)
        return out

    def matrix(self, grams: np.ndarray) -> np.ndarray:
        """int8 vectors of the n-grams, one row each."""
        pos = np.empty(len(grams), np.int64)
        fresh = []
        for i, g in enumerate(grams.tolist()):
            p = self.at.get(g, -1)
            if p < 0:
                v = self.bind(g)
                if len(self.at) < _CACHE:
                    p = self.at[g] = len(self.at)
                    self.rows[p] = v
                else:
                    fresh.append((i, v))
                    p = 0
            pos[i] = p
        out = self.rows[pos]
        for i, v in fresh:
            out[i] = v
        return out

    def bundle(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        out = np.zeros(self.dim)
        for lo in range(0, len(grams), 4096):
            out += counts[lo : lo + 4096].astype(np.float32) @ self.matrix(grams[lo : lo + 4096]).astype(np.float32)
        return out


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """Languages (sorted) and their unit prototypes, from rows with a text and a language."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters = letters_of_worker()
        for pdf in batches:
            out = []
            for lang, texts in pdf.groupby("lang")["text"]:
                got = [letters.grams(t) for t in texts]
                keys, back = np.unique(np.concatenate([g for g, _ in got]), return_inverse=True)
                n = np.bincount(back, weights=np.concatenate([c for _, c in got]), minlength=len(keys))
                out.append(pd.DataFrame({"lang": lang, "gram": keys.astype(np.int64), "n": n.astype(np.int64)}))
            yield pd.concat(out) if out else pd.DataFrame({"lang": [], "gram": [], "n": []})

    src = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    counts = map_rows(src.dropna(), count, "lang string, gram long, n long", ids=(), keep=("letters",)).groupBy("lang", "gram").agg(F.sum("n").alias("n"))

    def bundle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        space, sums = Space(), {}
        for pdf in batches:
            for lang, part in pdf.groupby("lang"):
                v = space.bundle(part["gram"].to_numpy().astype(np.uint64), part["n"].to_numpy())
                sums[lang] = sums.get(lang, 0) + v
        if sums:
            yield pd.DataFrame({"lang": list(sums), "v": list(sums.values())})

    parts = map_rows(counts, bundle, "lang string, v array<double>", ids=(), keep=("letters",), rows=1 << 16)
    summed = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    rows = summed.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")).orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: the language column does not hold language codes")
    langs = [r["lang"] for r in rows]
    proto = np.array([[x["x"] for x in r["v"]] for r in rows]).reshape(len(rows), DIM)
    return langs, proto / np.maximum(np.linalg.norm(proto, axis=1, keepdims=True), 1e-12)


def identify(docs: DataFrame, langs: list[str], proto: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score): the nearest prototype and its cosine, cut to 0..1.

    A text that is null or has no letter is ``und`` with score 0; so is every text if no
    language was learned.  Of equal cosines the alphabetically first language wins.  Null
    doc_ids keep their null; repeated rows are identified each.  Other columns are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast((langs, proto.T.astype(np.float64)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters, space = letters_of_worker(), Space()
        langs, proto = model.value
        for pdf in batches:
            pred, score = ["und"] * len(pdf), [0.0] * len(pdf)
            for i, text in enumerate(pdf["text"]):
                grams, counts = letters.grams(text)
                if not len(grams) or not langs:
                    continue
                v = space.bundle(grams, counts)
                cos = (v @ proto) / max(float(np.sqrt(v @ v)), 1e-12)
                best = int(cos.argmax())
                pred[i], score[i] = langs[best], float(min(1.0, max(0.0, cos[best])))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "lang_pred": pred, "score": score})

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_rows(src, run, "doc_id long, lang_pred string, score double", keep=("letters",))


def op6_hdc_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``; the fold crc32(doc_id) mod 5 = 0 teaches nothing.

    A row without a doc_id has no fold: it counts as held out.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(True))
    langs, proto = learn(docs.where(~held_out))
    return identify(docs, langs, proto).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
