"""Best-fit packing of whole documents into sequences by a grouping genetic algorithm.

Documents become token ids once; only pieces of (length, checksum) are kept.  A piece
that fills a sequence is one.  The others are dealt over shards of bounded size by a
hash, and each shard is evolved by several islands: a solution is a grouping of pieces
into bins, crossover injects whole well-filled bins of one parent into the other, drops
the bins that now hold duplicates and puts the displaced pieces back best-fit decreasing;
mutation dissolves badly filled bins.  After each epoch the elites move to the next
island of the shard.  Bins that stay badly filled in their shard are dissolved and
re-dealt among all shards' leftovers, in fewer shards, until few are left.
"""

from __future__ import annotations

import math
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain, islice
from itertools import count as counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import checkpointed
from .textkit import CACHES, map_rows

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
SHARD_ITEMS = 6000
ISLANDS = 2
EPOCHS = 2
POPULATION = 4
OFFSPRING = 6
#: Bins with more waste than this share go back into the pool of the next round.
LOOSE = 0.01
ROUNDS = 3
#: Bytes that a worker's cache of encoded strings may take, as counted by ``_COST``.
CACHE_BYTES = 72 << 20
#: Bytes of a cached string besides its characters and ids: the object, its place in the dictionary, its number.
_COST = 180


class _Numbered(defaultdict):
    """Numbers keys in order of first lookup, without Python code per lookup."""

    def __init__(self) -> None:
        super().__init__(counter().__next__)
        self.seen = 0

    def numbers(self, groups: list[list[str]], sizes: np.ndarray) -> np.ndarray:
        """The numbers of all keys of the groups, one after the other."""
        return np.fromiter(map(self.__getitem__, chain.from_iterable(groups)), np.int64, int(sizes.sum()))

    def unseen(self) -> list[str]:
        """Keys met since the last call, in order of their numbers."""
        new = list(islice(reversed(self), len(self) - self.seen))[::-1]
        self.seen = len(self)
        return new


def _gather(values: np.ndarray, starts: np.ndarray, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenation of values[starts[i]:starts[i + 1]] for i in picked, and the sizes."""
    first, size = starts[picked], starts[picked + 1] - starts[picked]
    ends = np.cumsum(size)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - size), size)
    return values[at], size


class _Ids:
    """Growing lists of ids; the arrays double, so that adding is linear."""

    def __init__(self) -> None:
        self.ids, self.at = np.empty(1 << 16, np.uint32), np.zeros(1 << 14, np.int64)
        self.n = self.lists = 0

    def add(self, ids: np.ndarray, ends: np.ndarray) -> None:
        """Further lists: their ids, and where each ends in them."""
        while self.n + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while self.lists + len(ends) + 1 > len(self.at):
            self.at = np.concatenate([self.at, np.empty_like(self.at)])
        self.ids[self.n : self.n + len(ids)] = ids
        self.at[self.lists + 1 : self.lists + 1 + len(ends)] = self.n + ends
        self.n, self.lists = self.n + len(ids), self.lists + len(ends)


class Encoder:
    """Token ids of whole texts, equal to the tokenizer's own, with a cache of bounded size.

    The tokenizer normalises (NFC, white space, lower case), drops white space, splits by a
    pattern and encodes each part on its own, so what stands between white space can be
    cached.  New parts are encoded many at a time, joined by spaces: each part is one word
    to the tokenizer and its last token alone carries the word-end mark.  They are normalised
    and split already, so the model alone encodes their bytes.  This is done only
    for texts in which Python's and the tokenizer's Unicode tables cannot differ (no
    character from U+0250, no odd control) and that name no special token; any other text
    goes to the tokenizer whole.
    """

    _odd = re.compile("[^\t-\r -ɏ]")
    _part = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼-¾]+|[\d²³¹¼-¾]|(?:[^\s\w]|_)+")

    def __init__(self, name: str = TOKENIZER) -> None:
        import public_tokenizers
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tok = Tokenizer.from_file(public_tokenizers.path(name))
        self.of_parts = Tokenizer(self.tok.model)
        self.of_parts.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.tok.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        self.closes[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.special = tuple(t.content.lower() for t in self.tok.get_added_tokens_decoder().values())
        self._reset()

    def _reset(self) -> None:
        self.chunks, self.parts = _Numbered(), _Numbered()
        self.of_chunk, self.of_part = _Ids(), _Ids()
        self.held = 0

    def _learn(self, chunks: list[str]) -> None:
        """Ids of the chunks, and of the parts in them, that were met for the first time."""
        split = list(map(self._part.findall, chunks))
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        parts = self.parts.numbers(split, sizes)
        new = self.parts.unseen()
        if new:
            lines = [" ".join(new[i : i + 200]) for i in range(0, len(new), 200)]
            ids = np.concatenate([np.array(e.ids, dtype=np.uint32) for e in self.of_parts.encode_batch_fast(lines, add_special_tokens=False)])
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(new):
                raise AssertionError("a part was not encoded as one word")
            self.of_part.add(ids, ends)
        ids, size = _gather(self.of_part.ids, self.of_part.at, parts)
        self.of_chunk.add(ids, np.append(0, np.cumsum(size))[np.cumsum(sizes)])
        self.held += sum(map(len, chunks)) + sum(map(len, new)) + _COST * (len(chunks) + len(new)) + 4 * len(ids)

    def encode(self, texts: list[str | None], batch: int = 256) -> Iterator[np.ndarray]:
        """uint32 ids of each text, in order; null is empty."""
        for lo in range(0, len(texts), batch):
            part = [t or "" for t in texts[lo : lo + batch]]
            if self.held > CACHE_BYTES:
                self._reset()
            low = [None if self._odd.search(t) else t.lower() for t in part]
            split = [t.split() if t is not None and not any(s in t for s in self.special) else None for t in low]
            del low
            sizes = np.fromiter((len(s or ()) for s in split), np.int64, len(split))
            found = self.chunks.numbers([s or [] for s in split], sizes)
            new = self.chunks.unseen()
            if new:
                self._learn(new)
            ids, size = _gather(self.of_chunk.ids, self.of_chunk.at, found)
            cuts = np.append(0, np.append(0, np.cumsum(size))[np.cumsum(sizes)]).tolist()
            for i, t in enumerate(part):
                if split[i] is None:
                    yield np.array(self.tok.encode(t, add_special_tokens=False).ids, dtype=np.uint32)
                else:
                    yield ids[cuts[i] : cuts[i + 1]]


def encoder_of(name: str = TOKENIZER) -> Encoder:
    """The worker's encoder: its cache serves all tasks that the worker runs."""
    if name not in CACHES:
        CACHES[name] = Encoder(name)
    return CACHES[name]


def pieces(docs: DataFrame, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """(uid, doc_id, piece, start, length, ids_crc32); uid is unique per piece of a row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = encoder_of()
        for pdf in batches:
            out = []
            for doc, ids in enumerate(encoder.encode(pdf["text"].tolist())):
                ids = np.append(ids, np.uint32(0)).astype("<u4", copy=False)
                for i, start in enumerate(range(0, len(ids), capacity)):
                    cut = ids[start : start + capacity]
                    out.append((doc, i, start, len(cut), zlib.crc32(cut.tobytes())))
            at, piece, start, length, crc = np.array(out, np.int64).reshape(-1, 5).T
            yield pd.DataFrame({"doc_id": pdf["doc_id"].array.take(at), "piece": piece, "start": start, "length": length, "ids_crc32": crc})

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = map_rows(src, run, "doc_id long, piece int, start long, length long, ids_crc32 long", keep=(TOKENIZER,), rows=1024)
    return out.withColumn("uid", F.monotonically_increasing_id())


def best_fit(order: np.ndarray, lengths: list[int], bins: list[list[int]], free: list[int], capacity: int) -> None:
    """Put items, in the given order, into the fullest bin that holds them; open bins as needed."""
    of_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for b, f in enumerate(free):
        of_free[f].append(b)
        mask |= 1 << f
    for i in order.tolist():
        n = lengths[i]
        rest = mask >> n
        if rest:
            f = n + (rest & -rest).bit_length() - 1
            stack = of_free[f]
            b = stack.pop()
            if not stack:
                mask ^= 1 << f
            bins[b].append(i)
        else:
            f, b = capacity, len(bins)
            bins.append([i])
            free.append(capacity)
        free[b] = f = f - n
        of_free[f].append(b)
        mask |= 1 << f


def evolve(lengths: np.ndarray, seed: int, start: list[np.ndarray], capacity: int = CAPACITY) -> list[np.ndarray]:
    """The two best groupings (bin of each item) after one epoch on one island, best first."""
    rng = np.random.default_rng(seed)
    size = lengths.tolist()
    n = len(size)

    def packed(order: np.ndarray) -> np.ndarray:
        bins: list[list[int]] = []
        best_fit(order, size, bins, [], capacity)
        return numbered(bins)

    def numbered(bins: list[list[int]]) -> np.ndarray:
        out = np.empty(n, np.int32)
        flat = np.fromiter((i for b in bins for i in b), np.int64, n)
        out[flat] = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
        return out

    def fitness(g: np.ndarray) -> float:
        fill = np.bincount(g, weights=lengths) / capacity
        return float((fill**2).sum() / len(fill))

    def rebuilt(g: np.ndarray, keep: np.ndarray, loose: np.ndarray, extra: list[list[int]]) -> np.ndarray:
        """Bins ``keep`` of g and ``extra`` bins as they are; items ``loose`` put back best-fit decreasing."""
        order = np.argsort(g, kind="stable")
        order = order[keep[g[order]]]
        cuts = np.flatnonzero(np.diff(g[order])) + 1
        bins = [x.tolist() for x in np.split(order, cuts)] if len(order) else []
        bins += extra
        free = [capacity - sum(size[i] for i in b) for b in bins]
        best_fit(loose[np.argsort(-lengths[loose], kind="stable")], size, bins, free, capacity)
        return numbered(bins)

    def cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        fill = np.bincount(b, weights=lengths)
        good = np.flatnonzero(fill >= np.quantile(fill, 0.3))
        chosen = np.zeros(len(fill), bool)
        chosen[good[rng.random(len(good)) < 0.5]] = True
        inside = chosen[b]
        keep = np.ones(int(a.max()) + 1, bool)
        keep[a[inside]] = False
        extra: dict[int, list[int]] = {}
        for i in np.flatnonzero(inside).tolist():
            extra.setdefault(int(b[i]), []).append(i)
        return rebuilt(a, keep, np.flatnonzero(~keep[a] & ~inside), list(extra.values()))

    def mutate(g: np.ndarray) -> np.ndarray:
        fill = np.bincount(g, weights=lengths)
        odds = 0.02 + 0.9 * (fill < capacity * 0.97)
        keep = rng.random(len(fill)) >= odds
        return rebuilt(g, keep, np.flatnonzero(~keep[g]), [])

    pop = [g.astype(np.int32) for g in start]
    if not pop:
        pop.append(packed(np.argsort(-lengths, kind="stable")))
    while len(pop) < POPULATION:
        noise = rng.normal(0, capacity * 0.04, n)
        pop.append(packed(np.argsort(-(lengths + noise), kind="stable")))
    scored = sorted(((fitness(g), i, g) for i, g in enumerate(pop)), key=lambda x: (-x[0], x[1]))
    for k in range(OFFSPRING):
        a, b = (scored[int(i)][2] for i in rng.choice(len(scored), 2, replace=False))
        child = mutate(cross(a, b))
        f = fitness(child)
        if f > scored[-1][0]:
            scored[-1] = (f, len(pop) + k, child)
            scored.sort(key=lambda x: (-x[0], x[1]))
    return [scored[0][2], scored[1][2]]


def _island(epoch: int, seed: int, capacity: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """One epoch of one island: its items and the elites that were sent to it."""

    def run(items: pd.DataFrame, elites: pd.DataFrame) -> pd.DataFrame:
        if not len(items):
            return pd.DataFrame({"shard": [], "island": [], "elite": [], "score": [], "bins": []})
        items = items.sort_values("uid")
        lengths = items["length"].to_numpy()
        shard, island = int(items["shard"].iloc[0]), int(items["island"].iloc[0])
        start = [np.frombuffer(b, np.int32) for b in elites.sort_values(["esrc", "elite"])["bins"]]
        found = evolve(lengths, zlib.crc32(f"{seed}:{epoch}:{shard}:{island}".encode()), start, capacity)
        return pd.DataFrame(
            {
                "shard": shard,
                "island": island,
                "elite": range(len(found)),
                "score": [int(g.max()) + 1 for g in found],
                "bins": [g.astype(np.int32).tobytes() for g in found],
            }
        )

    return run


def _place(number: int, capacity: int, last: bool) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Sequence and offset of each item of a shard under its best grouping; null for loose bins unless last."""

    def run(items: pd.DataFrame, best: pd.DataFrame) -> pd.DataFrame:
        if not len(items):
            return pd.DataFrame({"uid": [], "length": [], "sequence_id": [], "offset": []})
        items = items.sort_values("uid")
        best = best.sort_values(["score", "bsrc", "elite"])
        g = np.frombuffer(best["bins"].iloc[0], np.int32)
        lengths = items["length"].to_numpy()
        order = np.argsort(g, kind="stable")
        ends = np.cumsum(lengths[order])
        head = np.r_[True, np.diff(g[order]) > 0]
        base = (ends - lengths[order])[head][np.cumsum(head) - 1]
        offset = np.empty(len(g), np.int64)
        offset[order] = ends - lengths[order] - base
        fill = np.bincount(g, weights=lengths)
        tight = np.ones(len(fill), bool) if last else fill >= capacity * (1 - LOOSE)
        seq = (((number << 24) + int(items["shard"].iloc[0])) << 32) + g.astype(np.int64)
        out = pd.DataFrame({"uid": items["uid"].values, "length": lengths, "sequence_id": seq, "offset": offset})
        out = out.astype({"sequence_id": "Int64", "offset": "Int64"})
        out.loc[~tight[g], ["sequence_id", "offset"]] = None
        return out

    return run


def pack(items: DataFrame, capacity: int = CAPACITY, seed: int = 7) -> DataFrame:
    """(uid, sequence_id, offset) for items(uid, length) with 1 <= length < capacity."""
    done, pool, count = None, items, items.count()
    for number in range(1, ROUNDS + 1):
        shards = max(1, math.ceil(count / SHARD_ITEMS))
        last = number == ROUNDS or shards == 1
        dealt = pool.withColumn("shard", F.pmod(F.xxhash64("uid", F.lit(number)), F.lit(shards)).cast("int"))
        dealt = checkpointed(dealt.select("uid", "length", "shard"))
        on_islands = dealt.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))))
        elites = None
        for epoch in range(EPOCHS):
            if elites is None:
                sent = on_islands.where("false").select(
                    F.col("shard").alias("eshard"), F.col("island").alias("eisland"), F.col("island").alias("esrc"),
                    F.lit(0).alias("elite"), F.lit(None).cast("binary").alias("bins"),
                )
            else:
                own = elites.select(F.col("shard").alias("eshard"), F.col("island").alias("eisland"), F.col("island").alias("esrc"), "elite", "bins")
                moved = own.where("elite = 0").withColumn("eisland", F.pmod(F.col("eisland") + 1, F.lit(ISLANDS)))
                sent = own.unionByName(moved)
            step = on_islands.groupBy("shard", "island").cogroup(sent.groupBy("eshard", "eisland"))
            elites = checkpointed(
                step.applyInPandas(_island(epoch, seed + number, capacity), "shard int, island int, elite int, score int, bins binary")
            )
        best = elites.where("elite = 0").select(F.col("shard").alias("bshard"), F.col("island").alias("bsrc"), "elite", "score", "bins")
        placed = dealt.groupBy("shard").cogroup(best.groupBy("bshard")).applyInPandas(
            _place(number, capacity, last), "uid long, length long, sequence_id long, offset long"
        )
        placed = checkpointed(placed)
        tight = placed.where("sequence_id is not null").select("uid", "sequence_id", "offset")
        done = tight if done is None else done.unionByName(tight)
        if last:
            break
        pool = placed.where("sequence_id is null").select("uid", "length")
        count = pool.count()
        if not count:
            break
    return done


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece.

    A document is its ids and a closing 0; a null or empty text is that 0 alone.  Only
    documents longer than ``capacity`` are cut.  Every row is packed: null doc_ids keep their
    null, repeated rows are packed as often as they occur.  No rows give no rows.
    """
    cut = checkpointed(pieces(docs, capacity, id_col, text_col))
    placed = pack(cut.where(F.col("length") < capacity).select("uid", "length"), capacity)
    out = cut.join(placed, "uid", "left")
    alone = F.coalesce("sequence_id", -1 - F.col("uid"))
    return out.select(
        "doc_id", "piece", "start", "length", "ids_crc32", alone.alias("sequence_id"), F.coalesce("offset", F.lit(0)).cast("long").alias("offset")
    )


def op9_gga_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` into sequences of at most 2048 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
