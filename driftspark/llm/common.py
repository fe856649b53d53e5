"""Helpers shared by the corpus operators: names, byte-level numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..lineage import checkpoint_dir, cut, delete, delete_at_exit  # noqa: F401

#: Text bytes handled at once in a Python worker; numpy temporaries are about 40 times that.
SLICE_BYTES = 1 << 21

_B = 0x9E3779B97F4A7C15 | 1
_B_INV = pow(_B, -1, 1 << 64)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that clash with no column of df, ignoring case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def slices(batches: Iterable[pa.RecordBatch], column: int = 0, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that the text column of each piece is within limit, or is one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        arr = batch.column(column)
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(arr), 0), dtype=np.int64)
        done = np.cumsum(sizes)
        lo = 0
        while lo < batch.num_rows:
            base = done[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(done, base + limit, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def flat(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows, and each row's offsets; a null is empty."""
    arr = pa.compute.fill_null(arr, "").cast(pa.large_string())
    n = len(arr)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + n + 1]
    buf = arr.buffers()[2]
    data = np.frombuffer(buf, np.uint8)[offs[0] : offs[-1]] if buf is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Powers:
    """Powers of the hash base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            with np.errstate(over="ignore"):
                for name, base in (("up", _B), ("down", _B_INV)):
                    p = np.full(size, base, np.uint64)
                    p[0] = 1
                    setattr(self, name, np.cumprod(p, dtype=np.uint64))
        return self.up, self.down


def spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words (runs of bytes above 32), and each row's word offsets."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    solid = data > 32
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    before[offs[:-1][offs[:-1] < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    after[(offs[1:] - 1)[offs[1:] > 0]] = False
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """64-bit hashes of data[start:end] for all spans at once."""
    up, down = powers.get(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64))


def fold_case(data: np.ndarray) -> np.ndarray:
    """ASCII capitals in lower case, as bytes.lower does."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def grams(words: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's word n-grams and each row's offsets; a row of 1 to n-1 words has one, of all its words."""
    counts = np.diff(offs)
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    padded = np.concatenate([words, np.zeros(n - 1, np.uint64)])
    row_end = np.repeat(offs[1:], counts)
    at = np.arange(len(words))
    h = np.zeros(len(words), np.uint64)
    for k in range(n):
        inside = at + k < row_end
        h = np.where(inside, mix(h * np.uint64(0x9FB21C651E98DF25) + padded[k : k + len(words)] + np.uint64(k + 1)), h)
    made = np.where(counts > 0, np.maximum(counts - n + 1, 1), 0)
    first = np.concatenate([[0], np.cumsum(made)])
    keep = at - np.repeat(offs[:-1], counts) < np.repeat(made, counts)
    return h[keep], first


def tokens(text: Column) -> Column:
    """Number of white-space separated words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")
