"""Language-model scoring by prediction by partial matching over bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import col, cut, flat, slices

#: The order of the longest contexts: three bytes before the coded one.
ORDER = 3


def positions(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """At each byte, itself and the three before it in its row (NUL before the row's start), as one number."""
    n = len(data)
    out = data.astype(np.uint64)
    start = np.repeat(offs[:-1], np.diff(offs))
    at = np.arange(n)
    for k in range(1, ORDER + 1):
        prev = np.zeros(n, np.uint64)
        prev[k:] = data[:-k] if n > k else 0
        prev[at - k < start] = 0
        out |= prev << np.uint64(8 * k)
    return out


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grams (text, fold) of a partition with their counts; key: fold above 32 gram bits."""
    keys, counts, held = [], [], 0

    def flush() -> pa.RecordBatch:
        k, n = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(k, kind="stable")
        k, n = k[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        keys[:], counts[:] = [k[first]], [np.add.reduceat(n, first)]
        return pa.RecordBatch.from_arrays([pa.array(keys[0].astype(np.int64)), pa.array(counts[0])], names=["key", "n"])

    for batch in slices(batches):
        data, offs = flat(batch.column(0))
        if not len(data):
            continue
        fold = np.asarray(batch.column(1)).astype(np.uint64)
        g = np.sort(positions(data, offs) | np.repeat(fold, np.diff(offs)) << np.uint64(32))
        first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        keys.append(g[first])
        counts.append(np.diff(np.concatenate([first, [len(g)]])).astype(np.int64))
        held += len(first)
        if held > 4_000_000:
            flush()
            held = len(keys[0])
            if held > 3_000_000:
                yield flush()
                keys, counts, held = [], [], 0
    if keys:
        yield flush()


def code_lengths(gram: np.ndarray, n: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Bits of each gram's last byte after the bytes before it, in a trie with counts n.

    gram has all grams of the trie with the same two middle bytes, and maybe more
    groups of that kind; low[c, s] counts byte s after byte c in the whole trie.
    Method C: in a context with total t and d distinct bytes, a byte seen c times
    has c/(t+d) and the escape d/(t+d); bytes of the longer contexts are excluded
    from t and d after an escape. A context without any byte left costs nothing.
    """
    bits = np.zeros(len(gram))
    if not len(gram):
        return bits
    s = (gram & np.uint64(255)).astype(np.int64)
    c = (gram >> np.uint64(8) & np.uint64(255)).astype(np.int64)
    _, i3 = np.unique(gram >> np.uint64(8), return_inverse=True)
    u2, i2 = np.unique(gram >> np.uint64(8) & np.uint64(0xFFFF), return_inverse=True)
    child, j2 = np.unique(gram & np.uint64(0xFFFFFF), return_inverse=True)
    size = low.sum(0)
    seen3 = n > 0
    t3, d3 = np.bincount(i3, n), np.bincount(i3, seen3)
    c2 = np.bincount(j2, n)
    p2 = np.searchsorted(u2, child >> np.uint64(8))
    ch_c, ch_s = (child >> np.uint64(8) & np.uint64(255)).astype(np.int64), (child & np.uint64(255)).astype(np.int64)
    t2, d2 = np.bincount(p2, c2, len(u2)), np.bincount(p2, c2 > 0, len(u2))
    x2 = np.bincount(i3, np.where(seen3, c2[j2], 0))
    x1 = np.bincount(p2, np.where(c2 > 0, low[ch_c, ch_s], 0), len(u2))
    t1, d1, x0 = low.sum(1), (low > 0).sum(1), np.where(low > 0, size[None, :], 0).sum(1)

    def step(open_, count, total, distinct):
        """Codes the bytes with a count, lets the rest escape."""
        there = open_ & (distinct > 0)
        hit = there & (count > 0)
        miss = there & (count <= 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            bits[hit] -= np.log2(count[hit] / (total[hit] + distinct[hit]))
            bits[miss] -= np.log2(distinct[miss] / (total[miss] + distinct[miss]))
        return open_ & ~hit

    left = step(np.ones(len(gram), bool), n, t3[i3], d3[i3])
    left = step(left, c2[j2], t2[i2] - x2[i3], d2[i2] - d3[i3])
    left = step(left, low[c, s], t1[c] - x1[i2], d1[c] - d2[i2])
    left = step(left, size[s], size.sum() - x0[c], (size > 0).sum() - d1[c])
    bits[left] += np.log2(256 - (size > 0).sum())
    return bits


def coster(low: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Code lengths of all grams of a partition (whole groups of middle bytes) under each fold's trie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[np.asarray(b.column(i)) for i in range(3)] for b in batches]
        if got:
            gram, n0, n1 = (np.concatenate(x) for x in zip(*got))
            gram = gram.astype(np.uint64)
            costs = [code_lengths(gram, n.astype(float), low[f]) for f, n in enumerate((n0, n1))]
            yield pa.RecordBatch.from_arrays([pa.array(gram.astype(np.int64)), *(pa.array(x.astype(np.float32)) for x in costs)], names=["gram", "cost0", "cost1"])

    return run


def per_row(batch: pa.RecordBatch, text: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, gram and count of each row's distinct grams, and each row's bytes."""
    data, offs = flat(batch.column(text))
    size = np.diff(offs)
    row = np.repeat(np.arange(len(size), dtype=np.uint64), size)
    g = np.sort(positions(data, offs) | row << np.uint64(32))
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
    n = np.diff(np.concatenate([first, [len(g)]])) if len(g) else first
    return (g[first] >> np.uint64(32)).astype(np.int64), g[first] & np.uint64(0xFFFFFFFF), n, size


def scorer(table) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, costs = table.value
        for batch in slices(batches, 2):
            row, gram, n, size = per_row(batch, 2)
            other = 1 - np.asarray(batch.column(1)).astype(np.int64)
            cost = costs[other[row], np.searchsorted(known, gram.astype(np.uint32))]
            bits = np.bincount(row, cost.astype(float) * n, len(size))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(bits)], names=["doc_id", "n_bytes", "bits"])

    return run


def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    at = TaskContext.get().partitionId() << 40
    for batch in slices(batches, 2):
        row, gram, n, size = per_row(batch, 2)
        lone = np.flatnonzero(size == 0)
        row, gram, n = np.concatenate([row, lone]), np.concatenate([gram, np.zeros(len(lone), np.uint64)]), np.concatenate([n, np.zeros(len(lone), np.int64)])
        pick = pa.array(row)
        cols = [batch.column(0).take(pick), pa.array(size[row]), batch.column(1).take(pick), pa.array(at + row), pa.array(gram.astype(np.int64)), pa.array(n)]
        at += len(size)
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "fold", "row", "gram", "n"])


def ppm_score(docs: DataFrame, table_rows: int = 8_000_000, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Each row's code length under a byte trie of the corpus: doc_id, n_bytes, bits, bits_per_byte.

    Documents fall in two folds by the md5 of their text. The tries of contexts of
    up to three bytes gather every document of a fold; a document is coded by the
    trie of the other fold, which never saw it or its exact copies, with escapes
    by method C and symbol exclusion (see code_lengths). As a static trie gives a
    byte the same length wherever its context recurs, lengths are computed once
    for each distinct gram, grouped by its middle bytes, and then summed over the
    documents. The table of lengths is broadcast while it has at most table_rows
    rows (counted first); beyond, documents' grams join it by shuffle.

    Copies of a text fall in one fold, so that they do not teach each other; a text
    that occurs twice is therefore not told by its score. ORDER is three, as a
    byte's length then depends on four bytes, few enough that each is computed
    once; adaptive_score() takes any order.

    Null and empty texts: 0 bytes, 0 bits, bits_per_byte null; ids are whole numbers. With one document,
    its bytes cost 8 bits each, as the other fold is empty. Rows with equal or no
    id are scored each. Extra columns are not read. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    fold = (F.ascii(F.md5(F.coalesce(col(text), F.lit("")))) % 2).cast("int")
    rows = docs.select(col(doc_id).cast("long").alias("doc_id"), fold.alias("fold"), col(text).alias("text"))
    pairs = rows.select("text", "fold").mapInArrow(counted, "key long, n long")
    fold, gram = F.shiftright("key", 32), F.col("key").bitwiseAND(F.lit(0xFFFFFFFF))
    trie = cut(pairs.groupBy(gram.alias("gram")).agg(*[F.sum(F.when(fold == f, F.col("n")).otherwise(0)).alias(f"n{f}") for f in (0, 1)]))
    low = np.zeros((2, 256, 256))
    for key, n0, n1 in trie.groupBy(F.col("gram").bitwiseAND(F.lit(0xFFFF))).agg(F.sum("n0"), F.sum("n1")).collect():
        low[:, key >> 8, key & 255] = n0, n1
    costs = cut(trie.repartition(F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFF))).mapInArrow(coster(low), "gram long, cost0 float, cost1 float"))
    if costs.count() <= table_rows:
        got = costs.toArrow()
        known = got.column("gram").to_numpy().astype(np.uint32)
        order = np.argsort(known)
        both = np.stack([got.column(f"cost{f}").to_numpy()[order] for f in (0, 1)])
        table = spark.sparkContext.broadcast((known[order], both))
        scored = rows.mapInArrow(scorer(table), "doc_id long, n_bytes long, bits double")
    else:
        each = rows.mapInArrow(exploded, "doc_id long, n_bytes long, fold int, row long, gram long, n long")
        cost = F.when(F.col("fold") == 0, F.col("cost1")).otherwise(F.col("cost0"))
        scored = each.join(costs, "gram", "left").groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_bytes").alias("n_bytes"), F.coalesce(F.sum(cost.cast("double") * F.col("n")), F.lit(0.0)).alias("bits")).drop("row")
    return scored.withColumn("bits_per_byte", F.when(F.col("n_bytes") > 0, F.col("bits") / F.col("n_bytes")))


def adaptive_bits(data: bytes, order: int = ORDER) -> float:
    """Code length of one document under a trie that starts empty and learns each byte after coding it."""
    trie: dict[bytes, dict[int, int]] = {}
    bits = 0.0
    padded = b"\0" * order + data
    for i in range(order, len(padded)):
        s, out, done = padded[i], set(), False
        for k in range(order, -1, -1):
            seen = trie.get(padded[i - k : i], {})
            t, d = sum(n for x, n in seen.items() if x not in out), sum(x not in out for x in seen)
            if not d:
                continue
            if s in seen:
                bits -= float(np.log2(seen[s] / (t + d)))
                done = True
                break
            bits -= np.log2(d / (t + d))
            out |= seen.keys()
        if not done:
            bits += np.log2(256 - len(out))
        for k in range(order + 1):
            node = trie.setdefault(padded[i - k : i], {})
            node[s] = node.get(s, 0) + 1
    return bits


def adaptive_score(docs: DataFrame, order: int = ORDER, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Each row's code length under a trie of its own, that starts empty: doc_id, n_bytes, bits, bits_per_byte.

    The work is a walk over the bytes in Python, some 10 to 20 microseconds a byte
    and order; the memory is that of one text's contexts. No shuffle. Null and
    empty texts: 0 bytes, 0 bits, bits_per_byte null; equal texts get equal
    lengths. Extra columns are not read. An empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [(t or "").encode() for t in batch.column(1).to_pylist()]
            bits = [adaptive_bits(x, order) for x in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(bits, pa.float64())], names=["doc_id", "n_bytes", "bits"])

    scored = docs.select(col(doc_id).cast("long").alias("doc_id"), col(text).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, bits double")
    return scored.withColumn("bits_per_byte", F.when(F.col("n_bytes") > 0, F.col("bits") / F.col("n_bytes")))
