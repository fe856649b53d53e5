"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import col, cut, fresh, tokens

#: The level of all values that have no constraint of their own.
OTHER = "\x00other"


def word_counts(docs: DataFrame, columns: Sequence[str], text: str = "text") -> DataFrame:
    """Words by each combination of the columns' values, as strings: one pass over the texts for all targets."""
    keys = [col(c).cast("string").alias(c) for c in columns]
    (n,) = fresh(docs, "n_words")
    return cut(docs.groupBy(*keys).agg(F.sum(tokens(col(text))).cast("double").alias(n)))


def temper(counts: DataFrame, column: str, power: float) -> dict[str, float]:
    """Target shares proportional to each value's own share of words to a power, from word_counts().

    Each value with words is a level of its own, however rare; null is OTHER.
    """
    per = counts.groupBy(col(column).alias("v")).agg(F.sum(col(counts.columns[-1])).alias("n")).where("n > 0").collect()
    total, share = sum(r["n"] for r in per), {}
    for r in per:
        v = OTHER if r["v"] is None else r["v"]
        share[v] = share.get(v, 0.0) + r["n"] / total
    raw = {v: p**power for v, p in share.items()}
    whole = sum(raw.values())
    return {v: x / whole for v, x in sorted(raw.items())}


def attach(df: DataFrame, column: str, table: Mapping[str, float], name: str, rest: float) -> DataFrame:
    """df with the table's entry for each value of the column, and rest for null and all others.

    The table comes from the driver, so it is always broadcast.
    """
    if not table:
        return df.withColumn(name, F.lit(rest))
    key, entry = fresh(df, "level_key", "level_entry")
    rows = df.sparkSession.createDataFrame(pa.table({key: list(table), entry: list(table.values())}))
    joined = df.join(F.broadcast(rows), col(column).cast("string") == col(key), "left")
    return joined.withColumn(name, F.coalesce(col(entry), F.lit(rest))).drop(key, entry)


def summed(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and the sum of each one's values."""
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(at, np.concatenate(values), len(key))


def moments(dual: np.ndarray, places: Sequence[np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Value (0), gradient (from 1 on) and Hessian of the dual's data term, summed over a partition.

    places has each column's index in dual by level, -1 for levels left out. Levels of one column
    exclude one another, so besides the gradient the Hessian has only pairs of levels that occur together.
    """
    width = len(dual)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, grad = 0.0, np.zeros(width)
        keys, sums = [np.zeros(0, np.int64)], [np.zeros(0)]
        for batch in batches:
            n = np.asarray(batch.column(0), dtype=float)
            levels = np.stack([p[np.asarray(batch.column(i), dtype=np.int64)] for i, p in enumerate(places, 1)])
            keep = (n > 0) & (levels >= 0).all(0)
            n, levels = n[keep], levels[:, keep]
            w = n * np.exp(dual[levels].sum(0))
            value += w.sum()
            for i, x in enumerate(levels):
                grad += np.bincount(x, w, width)
                for y in levels[i + 1 :]:
                    keys.append(x * width + y)
                    sums.append(w)
            if sum(map(len, keys[1:])) > 1 << 20:
                keys, sums = ([x] for x in summed(keys, sums))
        key, total = summed(keys, sums)
        at = np.flatnonzero(grad)
        i, v = np.concatenate([[0], at + 1, key + width + 1]), np.concatenate([[value], grad[at], total])
        for lo in range(0, len(i), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(i[lo : lo + 100_000]), pa.array(v[lo : lo + 100_000])], names=["i", "v"])

    return run


def newton_step(grad: np.ndarray, diagonal: np.ndarray, i: np.ndarray, j: np.ndarray, v: np.ndarray, dense: int) -> np.ndarray:
    """Solves hessian @ step = grad for a Hessian with the diagonal and v at (i, j) and (j, i).

    Scaled to a diagonal of 1, so rare levels count as much as others; up to dense levels by
    least squares, beyond by conjugate gradients on the pairs alone.
    """
    width, root = len(grad), np.sqrt(np.where(diagonal > 0, diagonal, 1.0))
    one, b, v = (diagonal > 0) + 1e-12, grad / root, v / (root[i] * root[j])
    if width <= dense:
        hess = np.diag(one)
        hess[i, j], hess[j, i] = v, v
        return np.linalg.lstsq(hess, b, rcond=None)[0] / root
    x, r, p = np.zeros(width), b, b
    size = first = r @ r
    for _ in range(5000):
        if size <= 1e-24 * first:
            break
        q = one * p + np.bincount(i, v * p[j], width) + np.bincount(j, v * p[i], width)
        a = size / (p @ q)
        x, r = x + a * p, r - a * q
        size, last = r @ r, size
        p = r + size / last * p
    return x / root


def solve(cells: DataFrame, places: Sequence[np.ndarray], target: np.ndarray, tolerance: float = 1e-9, most: int = 100, dense: int = 1000) -> np.ndarray:
    """Newton's method on the convex dual sum(n exp(f.x)) - target.x; one distributed pass an iteration.

    It begins at 0 or where each column by itself would meet its targets, whichever is better. The
    driver holds one number for each pair of levels of two columns that occur together.
    """
    width = len(target)

    def evaluate(x: np.ndarray) -> tuple[float, np.ndarray, tuple]:
        got = cells.mapInArrow(moments(x, places), "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
        i, v = (got.column(c).to_numpy() for c in range(2))
        value, pair, diagonal = v[i == 0].sum(), i > width, np.zeros(width)
        single = (i > 0) & ~pair
        diagonal[i[single] - 1] = v[single]
        at = i[pair] - width - 1
        return value - target @ x, diagonal - target, (diagonal, at // width, at % width, v[pair])

    x = np.zeros(width)
    value, grad, hess = evaluate(x)
    alone = np.log(target / np.where(hess[0] > 0, hess[0], target))
    new = evaluate(alone)
    if new[0] < value:
        x, (value, grad, hess) = alone, new
    for _ in range(most):
        if (np.abs(grad) <= tolerance * target).all():
            break
        step = newton_step(grad, *hess, dense)
        size, slope = min(1.0, 8 / max(np.abs(step).max(), 1e-300)), grad @ step
        while True:
            new = evaluate(x - size * step)
            if new[0] <= value - 1e-4 * size * slope + 1e-12 * abs(value) or size < 1e-9:
                break
            size /= 2
        x, (value, grad, hess) = x - size * step, new
    return x


def mix_to_targets(
    docs: DataFrame,
    targets: Mapping[str, Mapping[str, float]],
    keep_all: bool = False,
    counts: DataFrame | None = None,
    text: str = "text",
    doc_id: str = "doc_id",
    rate: str = "rate",
    copies: str = "copies",
    n_tokens: str = "n_tokens",
) -> DataFrame:
    """docs with each row's rate, its whole number of copies and its word count.

    targets gives shares of the words for some values of one or more columns; all
    other values (null too) are one level OTHER, with the share that is left. The
    rates are the ones nearest to 1 in relative entropy, weighted by words, that
    meet every share exactly: an exponential tilt exp(sum of one dual value a
    column), found by Newton iterations over the distinct level combinations.
    Levels that no word has are left out and the rest scaled up to 1; a share
    of 0 gives rate 0. The rates keep the number of words; with keep_all they are then
    scaled up so that the least positive one is 1 and no such document is lost.
    copies is the rate rounded up or down by a hash of id and text, so that the
    expected number of copies is the rate.

    counts is word_counts() of the same documents and columns, if it is there already. The lists of
    levels are joined to the rows by broadcast; any number of them that the driver holds will do.

    Null and empty texts count no words and get their levels' rate. Targets that
    exclude one another end at the nearest mix after 100 iterations. Rows with
    equal id and text get the same number. Extra columns stay; if one has the
    name of a result column, the result's gets underscores before it. An empty
    table gives an empty table.
    """
    rate, copies, n_tokens = fresh(docs, rate, copies, n_tokens)
    columns = list(targets)
    names = [f"f{i}" for i in range(len(columns))]
    known = word_counts(docs, columns, text) if counts is None else counts
    listed = [[v for v in targets[c] if v != OTHER] for c in columns]
    coded = known.select(*[col(c) for c in columns], col(known.columns[len(columns)]).alias("n words"))
    for c, f, values in zip(columns, names, listed):  # level 0 is OTHER
        coded = attach(coded, c, {v: i for i, v in enumerate(values, 1)}, f"level {f}", 0)
    cells = cut(coded.groupBy(*[col(f"level {f}").alias(f) for f in names]).agg(F.sum(col("n words")).alias("n")).select("n", *names))
    shares, places, tables = [], [], []
    for c, f, values in zip(columns, names, listed):
        levels = [OTHER, *values]
        seen = {levels[r[0]] for r in cells.where("n > 0").select(f).distinct().collect()}
        want = dict(targets[c])
        want.setdefault(OTHER, max(0.0, 1 - sum(want.values())))
        total = sum(s for v, s in want.items() if v in seen)
        marks = {v: s / total for v, s in want.items() if v in seen and s > 0} if total > 0 else {v: 1 / len(seen) for v in seen}
        at = {v: len(shares) + i for i, v in enumerate(marks)}
        shares += marks.values()
        places.append(np.array([at.get(v, -1) for v in levels]))
        tables.append({v: float("-inf") if v in seen else 0.0 for v in levels})
    grand = cells.agg(F.sum("n")).first()[0] or 0.0
    if grand and shares and cells.mapInArrow(moments(np.zeros(len(shares)), places), "i long, v double").where("i = 0").agg(F.sum("v")).first()[0]:
        dual = solve(cells, places, np.array(shares) * grand)
    else:
        dual = np.zeros(len(shares))
    for table, at in zip(tables, places):
        table.update({v: float(dual[i]) for v, i in zip(table, at) if i >= 0})

    def tilted(df: DataFrame, name: str) -> DataFrame:
        """df with the rate before scaling: e to the sum of the levels' dual values."""
        parts = fresh(df, *[f"dual{i}" for i in range(len(columns))])
        for c, part, table in zip(columns, parts, tables):
            df = attach(df, c, {v: x for v, x in table.items() if v != OTHER}, part, table[OTHER])
        return df.withColumn(name, F.exp(sum((col(p) for p in parts), F.lit(0.0)))).drop(*parts)

    scale = 1.0
    if keep_all:
        (r,) = fresh(known, "r")
        least = tilted(known.where(col(known.columns[len(columns)]) > 0), r).where(col(r) > 0).agg(F.min(col(r))).first()[0]
        scale = 1 / least if least else 1.0
    rated = tilted(docs.withColumn(n_tokens, tokens(col(text))), rate)
    rated = rated.withColumn(rate, col(rate) * F.lit(scale) * F.lit(1 + 1e-12))
    if keep_all:  # a combination of levels without any word has no part in the least rate
        rated = rated.withColumn(rate, F.when(col(rate) > 0, F.greatest(col(rate), F.lit(1.0))).otherwise(col(rate)))
    u = (F.xxhash64(col(doc_id), col(text)).bitwiseAND(F.lit((1 << 53) - 1)).cast("double")) / F.lit(float(1 << 53))
    rated = rated.withColumn(copies, (F.floor(col(rate)) + (u < col(rate) - F.floor(col(rate))).cast("long")).cast("long"))
    return rated.select(*[col(c) for c in (*docs.columns, rate, copies, n_tokens)])
