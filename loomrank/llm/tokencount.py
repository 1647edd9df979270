"""Token counts by section: whole documents are encoded once and tokens are attributed by offsets.

A byte-level encoding is a partition of the text's bytes, so token byte lengths give every
token's span.  Sections (lines, by default) are byte spans of the same text; the interval
join of tokens to sections is a binary search in sorted boundaries.  A token that crosses
boundaries belongs to the section that holds most of its bytes, the earlier one of equals.
Encoding sections one by one would split such tokens and count others.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import map_rows

TOKENIZER = "byte_bpe_50k.tiktoken"


class Encoder:
    """Ids and byte lengths of the tokens of a text."""

    def __init__(self, name: str = TOKENIZER) -> None:
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.enc = tiktoken.Encoding("counts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.size[i] = len(token)

    def ids(self, text: str) -> np.ndarray:
        return self.enc.encode_to_numpy(text, disallowed_special=()).astype(np.int64)


def line_starts(raw: bytes) -> np.ndarray:
    """Byte offsets at which lines start; a line owns its line feed, and a text that ends in one has no further line."""
    ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    return np.concatenate(([0], ends[ends < len(raw)])).astype(np.int64)


def attribute(sizes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Section of each token: sizes are token byte lengths, starts the sections' first bytes (0 first)."""
    end = np.cumsum(sizes)
    begin = end - sizes
    first = np.searchsorted(starts, begin, side="right") - 1
    last = np.searchsorted(starts, end - 1, side="right") - 1
    for t in np.flatnonzero(last > first):
        cuts = np.concatenate(([begin[t]], starts[first[t] + 1 : last[t] + 1], [end[t]]))
        first[t] += int(np.diff(cuts).argmax())
    return first


def sections(encoder: Encoder, text: str) -> tuple[np.ndarray, ...]:
    """(section, start, length, n_tokens, n_crossing, doc_tokens) of the lines of a text."""
    raw = text.encode("utf-8", "surrogatepass")
    starts = line_starts(raw)
    sizes = encoder.size[encoder.ids(text)]
    where = attribute(sizes, starts) if len(sizes) else np.empty(0, np.int64)
    end = np.cumsum(sizes)
    stop = np.append(starts[1:], len(raw))
    cross = (end > stop[where]) | (end - sizes < starts[where])
    chars = np.cumsum(np.r_[0, (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80])
    n = len(starts)
    return np.arange(n), chars[starts], chars[stop] - chars[starts], np.bincount(where, minlength=n), np.bincount(where[cross], minlength=n), np.full(n, len(sizes))


def section_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, section, start, length, n_tokens, n_crossing, doc_tokens), one row per line of a document.

    start and length are code points, the line feed included; n_crossing counts the
    section's tokens that reach into another section; doc_tokens is the whole document's
    count, the sum of its sections.  A null or empty text is one empty section 0 with no
    tokens.  Null doc_ids keep their null; repeated rows are counted each.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(tokenizer)
        for pdf in batches:
            columns: list[list[np.ndarray]] = [[] for _ in range(6)]
            for text in pdf["text"]:
                for column, values in zip(columns, sections(encoder, text or "")):
                    column.append(values)
            counts = np.fromiter(map(len, columns[0]), np.int64, len(pdf))
            out = {"doc_id": pdf["doc_id"].array.take(np.repeat(np.arange(len(pdf)), counts))}
            names = ("section", "start", "length", "n_tokens", "n_crossing", "doc_tokens")
            yield pd.DataFrame(out | {n: np.concatenate(c) for n, c in zip(names, columns)})

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_rows(src, run, "doc_id long, section int, start long, length long, n_tokens long, n_crossing long, doc_tokens long", rows=512)


def op1_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every whole text of ``documents``."""
    return section_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
