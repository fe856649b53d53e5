"""Exact deduplication by two-pass Bloom filtering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import col, cut, fresh, mix


class Bloom:
    """A blocked Bloom filter over 64-bit hashes: four bits within one 64-bit word."""

    def __init__(self, keys: int, bits_per_key: int = 16) -> None:
        self.words = np.zeros(max(64, 1 << (max(1, keys * bits_per_key // 64) - 1).bit_length()), np.uint64)
        self.room = keys

    def _parts(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        g = mix(h)
        mask = np.zeros(len(h), np.uint64)
        for k in range(4):
            mask |= np.uint64(1) << ((g >> np.uint64(6 * k)) & np.uint64(63))
        return (g >> np.uint64(24)) % np.uint64(len(self.words)), mask

    def has(self, h: np.ndarray) -> np.ndarray:
        at, mask = self._parts(h)
        return (self.words[at] & mask) == mask

    def add(self, h: np.ndarray) -> None:
        at, mask = self._parts(h)
        np.bitwise_or.at(self.words, at, mask)
        self.room -= len(h)


def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes that, as far as the filters can tell, came before."""
    seen = [Bloom(1 << 16)]
    for batch in batches:
        h, n = np.unique(np.asarray(batch.column(0)).astype(np.int64).view(np.uint64), return_counts=True)
        old = np.logical_or.reduce([b.has(h) for b in seen])
        new = h[~old]
        if seen[-1].room < len(new):
            seen.append(Bloom(max(4 * len(new), 2 * 16 * len(seen[-1].words) // 4)))
        seen[-1].add(new)
        hits = h[old | (n > 1)]
        if len(hits):
            yield pa.RecordBatch.from_arrays([pa.array(hits.view(np.int64))], names=["h"])


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", broadcast_keys: int = 4_000_000) -> DataFrame:
    """One row of each distinct text: the one with the smallest id.

    Pass 1 sends only 64-bit text hashes, grouped by hash, through growing Bloom
    filters, which tell the hashes that possibly occur twice. Pass 2 marks the
    rows with such a hash: only these shuffle and are compared by their whole
    text; all others pass straight through. The hashes are broadcast while there
    are at most broadcast_keys of them (counted first); beyond, Spark joins by
    shuffle with the same result.

    Null text: such rows are no copies of one another, all stay. Empty texts are
    equal texts. Ties in the id (also wholly repeated rows): one row stays, the
    first by the JSON form of its other columns. A text shuffles once, as a key. A null id comes after all others. Extra columns are
    kept as they are, whatever their names. An empty table gives an empty table.
    """
    h, k, flag, order, best = fresh(docs, "h", "k", "flag", "order", "best")
    hashes = docs.where(col(text).isNotNull()).select(F.xxhash64(col(text)).alias("h"))
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = cut(hashes.repartition(parts, "h").mapInArrow(repeated, "h long").distinct())
    keys = found.select(F.col("h").alias(k), F.lit(True).alias(flag))
    if found.count() <= broadcast_keys:
        keys = F.broadcast(keys)
    hashed = docs.withColumn(h, F.when(col(text).isNotNull(), F.xxhash64(col(text))))
    marked = hashed.join(keys, col(h) == col(k), "left")
    names = [col(c) for c in docs.columns]
    unique = marked.where(col(flag).isNull()).select(*names)
    others = [c for c in docs.columns if c != text]
    first = F.struct(col(doc_id).isNull(), col(doc_id), F.to_json(F.struct(*[F.struct(col(c)) for c in others])))
    rest = (
        marked.where(col(flag).isNotNull())
        .select(col(h).alias(h), col(text).alias(k), F.struct(*[col(c) for c in others]).alias(best), first.alias(order))
        .groupBy(h, k)
        .agg(F.min_by(best, order).alias(best))
        .select(*[col(k).alias(c) if c == text else col(best).getField(c).alias(c) for c in docs.columns])
    )
    return unique.unionByName(rest)
