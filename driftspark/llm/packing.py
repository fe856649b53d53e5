"""Best-fit packing of documents into fixed-length sequences."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import col, cut, tokens

SCHEMA = "shard long, bin long, slot int, doc_id long, start long, length long"


class BestFit:
    """Bounded-space online best-fit.

    At most open_bins bins are open. A bitset has bit f set where a bin with f
    free places is open; the best fit for a piece of n is its lowest bit from n
    on. If nothing fits and all bins are open, the fullest one closes first. A
    piece that fills a bin by itself closes none.
    """

    def __init__(self, capacity: int, open_bins: int) -> None:
        self.capacity, self.most = capacity, open_bins
        self.free, self.count, self.bins, self.made = 0, 0, {}, 0

    def put(self, n: int) -> tuple[int, int]:
        """The bin and slot of a piece of 1 to capacity places."""
        fits = self.free >> n
        if fits:
            f = n + (fits & -fits).bit_length() - 1
            number, slot = self._take(f)
        else:
            if self.count == self.most and n < self.capacity:
                self._take((self.free & -self.free).bit_length() - 1)
            f, number, slot = self.capacity, self.made, 0
            self.made += 1
        if f > n:
            self.bins.setdefault(f - n, []).append((number, slot + 1))
            self.free |= 1 << (f - n)
            self.count += 1
        return number, slot

    def _take(self, f: int) -> tuple[int, int]:
        stack = self.bins[f]
        out = stack.pop()
        if not stack:
            del self.bins[f]
            self.free ^= 1 << f
        self.count -= 1
        return out


def packer(capacity: int, open_bins: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, fit = None, BestFit(capacity, open_bins)
        for batch in batches:
            out: list[list] = [[] for _ in types]
            add = [x.append for x in out]
            for s, doc, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if s != shard:
                    shard, fit = s, BestFit(capacity, open_bins)
                if not n:
                    for put, v in zip(add, (s, None, None, doc, 0, 0)):
                        put(v)
                for start in range(0, n, capacity):
                    length = min(capacity, n - start)
                    number, slot = fit.put(length)
                    for put, v in zip(add, (s, number, slot, doc, start, length)):
                        put(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names=names)

    return run


def best_fit_pack(docs: DataFrame, capacity: int = 2048, open_bins: int = 64, shard_tokens: int = 1 << 22, task_rows: int = 1 << 20, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Sequences of at most capacity words: one row (shard, bin, slot, doc_id, start, length) a piece.

    Documents go to shards of about shard_tokens words by a hash of id and
    length; the order within a shard is that of another hash, so the result does
    not depend on the number of partitions. Only ids and lengths shuffle. Longer
    documents are cut into pieces of capacity words and a rest; every word is in
    exactly one piece. open_bins is the space bound of the method, not a cap on
    the input. A task takes whole shards, one after another, of about task_rows
    documents together.

    Null and empty texts have no words: one row with bin and slot null and
    length 0. Rows with the same or no id are packed each on its own; doc_id is
    then repeated or null. Extra columns are not read. An empty table gives an
    empty table.
    """
    lens = cut(docs.select(col(doc_id).cast("long").alias("doc_id"), tokens(col(text)).alias("n")))
    total, rows = lens.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    shards = max(1, -(-total // shard_tokens))
    tasks = min(shards, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // task_rows)))
    spread = lens.withColumn("shard", F.pmod(F.xxhash64("doc_id", "n"), F.lit(shards)))
    ordered = spread.repartitionById(tasks, F.pmod("shard", F.lit(tasks)).cast("int")).sortWithinPartitions("shard", F.xxhash64(F.lit(7), "doc_id", "n"), "doc_id", "n")
    return ordered.select("shard", "doc_id", "n").mapInArrow(packer(capacity, open_bins), SCHEMA)
