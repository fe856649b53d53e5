"""Joins of texts with the fragments that they contain, by Aho-Corasick automata."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

try:
    import ahocorasick
except ImportError:  # no automaton module: a trie of dictionaries does the same, slower
    ahocorasick = None


class Trie:
    """An Aho-Corasick automaton of dictionaries, with the calls of the compiled one that are used here."""

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.value: list = [None]

    def add_word(self, word: str, value: int) -> None:
        node = 0
        for c in word:
            if c not in self.next[node]:
                self.next[node][c] = len(self.next)
                self.next.append({})
                self.value.append(None)
            node = self.next[node][c]
        self.value[node] = value

    def make_automaton(self) -> None:
        n = len(self.next)
        self.fail, self.out = [0] * n, [0] * n
        queue = list(self.next[0].values())
        for node in queue:
            for c, child in self.next[node].items():
                f = self.fail[node]
                while f and c not in self.next[f]:
                    f = self.fail[f]
                f = self.next[f].get(c, 0)
                self.fail[child] = f if f != child else 0
                self.out[child] = self.fail[child] if self.value[self.fail[child]] is not None else self.out[self.fail[child]]
                queue.append(child)

    def iter(self, text: str) -> Iterator[tuple[int, int]]:
        node = 0
        for i, c in enumerate(text):
            while node and c not in self.next[node]:
                node = self.fail[node]
            node = self.next[node].get(c, 0)
            at = node if self.value[node] is not None else self.out[node]
            while at:
                yield i, self.value[at]
                at = self.out[at]


def automaton(words: list[str]):
    made = ahocorasick.Automaton() if ahocorasick else Trie()
    for i, w in enumerate(words):
        made.add_word(w, i)
    made.make_automaton()
    return made


def finder(shards, at: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows with the id of each fragment within their text, column at. One automaton at a time is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, object] = {}
        for batch in batches:
            rows, ids = [], []
            texts = batch.column(at).to_pylist()
            for k, (numbers, words) in enumerate(shards.value):
                if k not in made:
                    made.clear()
                    made[k] = automaton(words)
                for i, text in enumerate(texts):
                    found = sorted({v for _, v in made[k].iter(text)})
                    rows += [i] * len(found)
                    ids += [numbers[v] for v in found]
            if rows:
                out = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(ids, pa.int64())], names=[f"c{i}" for i in range(len(out.columns) + 1)])

    return run


def _by_window(rows: DataFrame, text: str, words: DataFrame, chars: int, most_heads: int) -> DataFrame:
    """Candidates: rows with _part, by the hash of a fragment's first chars characters against those from each place of a text.

    Up to most_heads hashes (8 bytes each, counted first) are broadcast to leave out all other places.
    """
    spark = rows.sparkSession

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = [int(_rolled(p[:chars], chars)[0]) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(h, pa.int64())], names=["_part", "_h"])

    wanted = words.select("_part", "_w").mapInArrow(heads, "_part long, _h long")
    distinct = wanted.select("_h").distinct()
    known = None
    if distinct.limit(most_heads + 1).count() <= most_heads:
        known = spark.sparkContext.broadcast(np.sort(distinct.toArrow().column(0).to_numpy()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen = np.unique(_rolled(value, chars))
                if known is not None and len(seen):
                    at = np.minimum(np.searchsorted(known.value, seen), max(0, len(known.value) - 1))
                    seen = seen[known.value[at] == seen] if len(known.value) else seen[:0]
                if len(seen):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), key, np.int64)), pa.array(seen)], names=["_key", "_h"])

    found = rows.select(F.xxhash64(text), F.col(text)).mapInArrow(places, "_key long, _h long").join(wanted, "_h").select("_key", "_part").distinct()
    return rows.withColumn("_key", F.xxhash64(text)).join(found, "_key").drop("_key")


def _rolled(text: str, n: int) -> np.ndarray:
    """Polynomial hashes of the n characters from each place on."""
    if len(text) < n:
        return np.zeros(0, np.int64)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    h = np.zeros(len(codes) - n + 1, np.uint64)
    for k in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + len(h)]
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def contains_join(texts: DataFrame, parts: DataFrame, text: str = "text", part: str = "part", pool_chars: int = 50_000_000, shard_chars: int = 4_000_000, key_chars: int = 24, most_heads: int = 20_000_000) -> DataFrame:
    """All pairs of a row of texts and a row of parts whose fragment the text contains, with the columns of both.

    Distinct fragments of at most pool_chars characters together (counted first)
    are broadcast, and each text runs once through automata of about shard_chars
    characters: the work grows with texts and matches, not with texts times
    fragments, and texts do not shuffle. In a larger pool, fragments meet the
    texts by hashes of their first key_chars characters (ids and hashes shuffle)
    and then are compared as a whole; shorter fragments run through automata, or
    beyond the same count meet by all their characters. Null and empty fragments
    and null texts are in no pair.
    """
    spark = texts.sparkSession
    pool = parts.where(F.col(part).isNotNull() & (F.col(part) != ""))
    words = pool.select(F.col(part).alias("_w")).distinct().withColumn("_part", F.xxhash64("_w"))
    rows = texts.where(F.col(text).isNotNull())
    at, schema = texts.columns.index(text), T.StructType([*texts.schema.fields, T.StructField("_part", T.LongType())])

    def run(short: DataFrame) -> DataFrame:
        held, size = [([], [])], 0
        for number, word in short.select("_part", "_w").orderBy("_w").toLocalIterator():
            if size and size + len(word) > shard_chars:
                held.append(([], []))
                size = 0
            held[-1][0].append(number)
            held[-1][1].append(word)
            size += len(word)
        return rows.mapInArrow(finder(spark.sparkContext.broadcast([h for h in held if h[0]]), at), schema)

    def total(df: DataFrame) -> int:
        return df.agg(F.coalesce(F.sum(F.length("_w")), F.lit(0))).first()[0]

    if total(words) <= pool_chars:
        hits = run(words)
    else:
        long, short = words.where(F.length("_w") >= key_chars), words.where(F.length("_w") < key_chars)
        hits = _by_window(rows, text, long, key_chars, most_heads)
        if total(short) <= pool_chars:
            hits = hits.unionByName(run(short))
        else:
            for (n,) in short.select(F.length("_w")).distinct().collect():
                hits = hits.unionByName(_by_window(rows, text, short.where(F.length("_w") == n), n, most_heads))
    return hits.join(pool.withColumn("_part", F.xxhash64(part)), "_part").where(F.contains(F.col(text), F.col(part))).drop("_part")
