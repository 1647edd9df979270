"""Word and shingle hashing shared by the text operators (NumPy, batch at a time).

Words are the maximal runs of bytes outside space and 0x09-0x0D after lower-casing
A-Z only; ``bytes.lower`` and ``bytes.split`` do exactly that on UTF-8, because no
multi-byte sequence contains an ASCII byte.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

U64 = np.uint64
_C1, _C2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_GOLD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser over a uint64 array."""
    x = (x ^ (x >> U64(30))) * _C1
    x = (x ^ (x >> U64(27))) * _C2
    return x ^ (x >> U64(31))


def seed64(n: int) -> np.uint64:
    """The n-th well-separated 64-bit constant."""
    return U64(((n + 1) * _GOLD) & _MASK)


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words of a text; null and blank texts have none."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_hashes(ws: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, ws), U64, len(ws))


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles.

    With fewer than k words the whole sequence is the one shingle; no words, no shingles.
    """
    h = word_hashes(words(text))
    return np.unique(window_hashes(h, min(k, len(h)), k)) if len(h) else h


def window_hashes(h: np.ndarray, width: int, k: int) -> np.ndarray:
    """Hash of every window of ``width`` word hashes, in order; k seeds the family."""
    n = len(h) - width + 1
    if n <= 0 or width <= 0:
        return np.empty(0, U64)
    acc = np.full(n, seed64(1000 + 64 * k + width), U64)
    for i in range(width):
        acc += h[i : i + n] * (seed64(i) | U64(1))
    return mix64(acc)


def to_long(x: np.ndarray) -> np.ndarray:
    """Reinterpret uint64 as the int64 that Spark stores."""
    return x.view(np.int64)


#: What a worker keeps from task to task, by name.
CACHES: dict[str, object] = {}


def release(*keep: str) -> None:
    """Drop other caches and give freed memory back: workers live on between tasks and stages."""
    for name in CACHES.keys() - set(keep):
        del CACHES[name]
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def framed(batch: pa.RecordBatch, ids: frozenset[str]) -> pd.DataFrame:
    """The batch in pandas; the columns ``ids`` as nullable integers."""
    exact = {pa.int64(): pd.Int64Dtype()}.get
    return pd.DataFrame({f.name: c.to_pandas(types_mapper=exact) if f.name in ids else c.to_pandas() for f, c in zip(batch.schema, batch.columns)})


def map_rows(
    df: DataFrame,
    run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]],
    schema: str,
    ids: tuple[str, ...] = ("doc_id",),
    keep: tuple[str, ...] = (),
    rows: int = 2048,
) -> DataFrame:
    """``df.mapInPandas(run, schema)`` in frames of at most ``rows`` rows, with exact ids and tidy workers.

    pandas turns integers beside a null into floats, which rounds ids above 2^53; the columns
    ``ids`` are nullable integers instead.  A task starts and ends without the caches of
    other operators (but for ``keep``).
    """
    exact, target = frozenset(ids), to_arrow_schema(_parse_datatype_string(schema))

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(*keep)
        frames = (framed(b.slice(lo, rows), exact) for b in batches for lo in range(0, b.num_rows, rows))
        for out in run(frames):
            if len(out):
                yield pa.RecordBatch.from_pandas(out, schema=target, preserve_index=False)
        release(*keep)

    return df.mapInArrow(mapped, schema)
