"""Pluggable encoders, pair scorers and extractors: a factory runs once per worker, then scores Arrow batches.

The defaults are deterministic stand-ins, so that plans and tests need no model files.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Encoder = Callable[[list[str]], np.ndarray]
Scorer = Callable[[list[str], list[str]], list[float]]


def hashing_encoder(dim: int = 64) -> Encoder:
    """Signed hashing of words and their trigrams."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                for f in (w, *(w[j : j + 3] for j in range(len(w) - 2))):
                    h = zlib.crc32(f.encode())
                    out[i, h % dim] += 1 - 2 * (h >> 31)
        return out

    return encode


def word_overlap_scorer() -> Scorer:
    def score(a: list[str], b: list[str]) -> list[float]:
        sets = ((set((x or "").lower().split()), set((y or "").lower().split())) for x, y in zip(a, b))
        return [len(x & y) / max(1, len(x)) for x, y in sets]

    return score


def encode(c: Column | str, factory: Callable[[], Encoder] = hashing_encoder, prefix: str = "", normalize: bool = True) -> Column:
    """Embedding column; a zero vector stays zero."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for texts in batches:
            v = np.asarray(model([prefix + (t or "") for t in texts]), dtype=np.float64)
            if normalize:
                n = np.linalg.norm(v, axis=1, keepdims=True)
                v = v / np.where(n == 0, 1.0, n)
            yield pd.Series(list(v.astype(np.float32)))

    return run(c)


def pair_score(a: Column | str, b: Column | str, factory: Callable[[], Scorer] = word_overlap_scorer) -> Column:
    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = factory()
        for x, y in batches:
            yield pd.Series(model(x.tolist(), y.tolist()), dtype="float64")

    return run(a, b)


def generate(prompt: Column | str, factory: Callable[[], Callable[[list[str]], list[str]]]) -> Column:
    """Text generation column (hypothetical documents, attribute answers)."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for prompts in batches:
            yield pd.Series(model([p or "" for p in prompts]), dtype=object)

    return run(prompt)
