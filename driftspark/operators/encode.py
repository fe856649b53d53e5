"""The boundary to a model: message prefixes in, layer tensors out, by Arrow batches.

An Encoder is made once a Python worker. Task prefixes, the same for all steps of
a trajectory, are encoded once and joined back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.text import char_tokens

MARKER = "[... truncated ...]"
HEAD_SHARE, LEAST_REST = 0.25, 10


class Encoder(Protocol):
    def __call__(self, prefixes: Sequence[list[dict]], tasks: Sequence[str]) -> list[list[list[float]]]:
        """A (layer, hidden) tensor of each prefix with its task."""


class HashEncoder:
    """A deterministic stand-in for a model: floats in [-1, 1) from hashes of the text and layer."""

    def __init__(self, layers: int = 4, hidden: int = 16) -> None:
        self.layers, self.hidden = layers, hidden

    def __call__(self, prefixes: Sequence[list[dict]], tasks: Sequence[str]) -> list[list[list[float]]]:
        return [[self._layer(p, t, k) for k in range(self.layers)] for p, t in zip(prefixes, tasks)]

    def _layer(self, prefix: list[dict], task: str, layer: int) -> list[float]:
        text = "\x1e".join(f"{m['role']}\x1f{m['content']}" for m in prefix)
        raw = hashlib.shake_256(f"{layer}\x1d{text}\x1d{task}".encode()).digest(2 * self.hidden)
        return [int.from_bytes(raw[i : i + 2], "big") / 32768 - 1 for i in range(0, len(raw), 2)]


def truncate(messages: list[dict], budget: int, count: Callable[[str], int] = len) -> list[dict]:
    """Messages within a token budget: a quarter from the front, the rest from the back.

    A message at either edge keeps as much of its beginning as fits, if that is at
    least LEAST_REST tokens. A marker is put at the seam, within the budget.
    """

    def cut(m: dict, room: int) -> dict:
        text = m["content"] or ""
        if not text or room <= 0:
            return {**m, "content": ""}
        lo, hi = 0, len(text)
        if count(text) <= room:
            return m
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if count(text[:mid]) <= room else (lo, mid - 1)
        return {**m, "content": text[:lo]}

    sizes = [count(m["content"] or "") for m in messages]
    if sum(sizes) <= budget:
        return messages
    room = max(1, budget - count("\n" + MARKER))
    front = max(1, int(room * HEAD_SHARE))
    back = room - front

    def take(order: Iterator[int], rest: int) -> tuple[list[dict], int]:
        kept, seen = [], 0
        for i in order:
            if sizes[i] <= rest:
                kept.append(messages[i])
                rest -= sizes[i]
            elif rest >= LEAST_REST:
                kept.append(cut(messages[i], rest))
                return kept, seen + 1
            else:
                break
            seen += 1
        return kept, seen

    head, used = take(iter(range(len(messages))), front)
    tail, _ = take(iter(range(len(messages) - 1, used - 1, -1)), back)
    tail.reverse()
    if head:
        head[-1] = {**head[-1], "content": (head[-1]["content"] or "").rstrip() + "\n" + MARKER}
    elif tail:
        tail[0] = {**tail[0], "content": MARKER + "\n" + (tail[0]["content"] or "").lstrip()}
    return head + tail or [cut(messages[-1], budget)]


def truncated(messages: Column, budget: int, counter: Callable[[], Callable[[str], int]] | None = None) -> Column:
    """The same by Arrow batches; lists that fit are left as they are.

    counter() makes a tokenizer's count once a worker; without it a character is a token.
    """
    kind = "array<struct<role:string,content:string>>"

    @F.pandas_udf(kind)
    def run(lists: pd.Series) -> pd.Series:
        count = once(counter) if counter else len
        return lists.map(lambda ms: truncate([dict(m) for m in ms], budget, count) if ms is not None else None)

    plain = F.transform(messages, lambda m: F.struct(m["role"].alias("role"), F.coalesce(m["content"], F.lit("")).alias("content")))
    # a tokenizer's tokens are whole characters or parts of them, so a list within a quarter of the budget fits in any case
    fits = char_tokens(messages) <= (budget if counter is None else budget // 4)
    return F.when(fits, plain).otherwise(run(plain))


_made: dict[str, Encoder] = {}


def once(make: Callable[[], Encoder]) -> Encoder:
    """The encoder of this Python worker, made by the first task that needs it and kept for the later ones."""
    key = hashlib.sha1(cloudpickle.dumps(make)).hexdigest()
    if key not in _made:
        _made.clear()  # never two models at once
        _made[key] = make()
    return _made[key]


def encoded(rows: DataFrame, make: Callable[[], Encoder], prefix: str, task: str, out: str, batch_rows: int = 32) -> DataFrame:
    """rows with a tensor of prefix and task; the model sees batch_rows of them at once."""
    schema = T.StructType([*[f for f in rows.schema.fields if f.name != prefix], T.StructField(out, T.ArrayType(T.ArrayType(T.FloatType())))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = once(make)
        for pdf in batches:
            states: list = []
            for lo in range(0, len(pdf), batch_rows):
                part = pdf.iloc[lo : lo + batch_rows]
                states += encoder([[dict(m) for m in p] for p in part[prefix]], [t or "" for t in part[task]])
            yield pdf.drop(columns=prefix).assign(**{out: states})

    return rows.mapInPandas(run, schema)


def activations(steps: DataFrame, make: Callable[[], Encoder] = HashEncoder, key: str = "sample_index") -> DataFrame:
    """Steps with task, history and post tensors.

    Each distinct prefix of a trajectory is encoded once: the task prefix once a
    trajectory, and a history that equals an earlier post state (tool messages
    side by side) with it.
    """
    at = F.col("tool_message_index")
    pair = lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))
    base = steps.select(key, "task_text", "messages", at.alias("history"), (at + 1).alias("post"))
    wanted = base.select(key, "task_text", "messages", F.explode(F.array("history", "post")).alias("length"))
    wanted = wanted.dropDuplicates([key, "length"]).select(key, "length", "task_text", F.transform(F.slice("messages", F.lit(1), F.col("length")), pair).alias("prefix"))
    tasks = base.dropDuplicates([key]).select(key, F.lit(-1).alias("length"), "task_text", F.transform(F.filter("messages", lambda m: m["role"] == "system"), pair).alias("prefix"))
    # One pass through the model and one join: a trajectory's states by prefix length.
    states = encoded(wanted.unionByName(tasks), make, "prefix", "task_text", "state")
    states = states.groupBy(F.col(key).alias("_k")).agg(F.map_from_entries(F.collect_list(F.struct("length", "state"))).alias("_states"))
    out = steps.join(states, F.col(key) == F.col("_k"))
    for name, length in (("task", F.lit(-1)), ("history", at), ("post", at + 1)):
        out = out.withColumn(name, F.element_at("_states", length))
    return out.drop("_k", "_states")
