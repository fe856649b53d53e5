"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Powers, col, flat, fold_case, fresh, grams, slices, span_hashes, spans

FEATURES = (
    "log_bytes log_words word_length longest_word upper digits marks spaces wide lines line_length "
    "distinct_words top_word repeated_trigrams repeated_lines marked_words capital_words stops commas bars entropy"
).split()


def _sums(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return (total[offs[1:]] - total[offs[:-1]]).astype(float)


def runs(rows: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of each of n rows, and how often its most frequent one occurs."""
    if not len(keys):
        return np.zeros(n), np.zeros(n)
    k = np.sort((rows.astype(np.uint64) << np.uint64(44)) | (keys >> np.uint64(20)))
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    row = (k[first] >> np.uint64(44)).astype(np.int64)
    top = np.zeros(n)
    np.maximum.at(top, row, np.diff(np.concatenate([first, [len(k)]])))
    return np.bincount(row, minlength=n).astype(float), top


def statistics(data: np.ndarray, offs: np.ndarray, powers: Powers) -> np.ndarray:
    """FEATURES of each row's bytes; all ratios of an empty row are 0."""
    n, size = len(offs) - 1, np.diff(offs).astype(float)
    starts, ends, woffs = spans(data, offs)
    words, wrow, wlen = np.diff(woffs).astype(float), np.repeat(np.arange(n), np.diff(woffs)), ends - starts
    upper = (data >= 65) & (data <= 90)
    lower = (data >= 97) & (data <= 122)
    digit = (data >= 48) & (data <= 57)
    wide = data >= 128
    space = data <= 32
    mark = ~(upper | lower | digit | wide | space)
    h = span_hashes(fold_case(data), starts, ends, powers) if len(starts) else np.zeros(0, np.uint64)
    distinct, top = runs(wrow, h, n)
    tri, toffs = grams(h, woffs, 3)
    tdistinct = runs(np.repeat(np.arange(n), np.diff(toffs)), tri, n)[0]
    breaks = np.flatnonzero(data == 10)
    lstart = np.unique(np.concatenate([offs[:-1], breaks + 1]))
    lstart = lstart[lstart < len(data)]
    lend = np.concatenate([lstart[1:], [len(data)]]) if len(lstart) else lstart
    lrow = np.searchsorted(offs, lstart, "right") - 1
    lcount = np.bincount(lrow, minlength=n).astype(float)
    ldistinct = runs(lrow, span_hashes(data, lstart, lend, powers), n)[0] if len(lstart) else np.zeros(n)
    last = data[ends - 1] if len(ends) else data[:0]
    marked = np.isin(last, np.frombuffer(b"!#$%&*+<=>@^_|~", np.uint8))
    hist = np.bincount(np.repeat(np.arange(n), np.diff(offs)) * 256 + data, minlength=n * 256).reshape(n, 256) if len(data) else np.zeros((n, 256))
    b, w, t, l = (np.maximum(x, 1) for x in (size, words, np.diff(toffs).astype(float), lcount))
    p = hist / b[:, None]
    longest = np.zeros(n)
    np.maximum.at(longest, wrow, wlen)
    cols = [
        np.log1p(size), np.log1p(words), np.bincount(wrow, wlen, n) / w, np.log1p(longest), _sums(upper, offs) / b,
        _sums(digit, offs) / b, _sums(mark, offs) / b, _sums(space, offs) / b, _sums(wide, offs) / b, np.log1p(lcount), np.log1p(size / l),
        distinct / w, top / w, 1 - tdistinct / t, 1 - ldistinct / l, np.bincount(wrow, marked, n) / w,
        np.bincount(wrow, upper[starts], n) / w, _sums(np.isin(data, [33, 46, 63]), offs) / w, _sums(data == 44, offs) / w, _sums(data == 124, offs) / w,
        -(p * np.log2(np.maximum(p, 1e-12))).sum(1),
    ]
    out = np.stack(cols, 1)
    out[size == 0] = 0
    return out


class Trees:
    """Complete binary trees of one depth in flat arrays: inner node i has the children 2i+1 and 2i+2."""

    def __init__(self, bias: float, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray) -> None:
        self.bias, self.feature, self.threshold, self.value = bias, feature, threshold, value

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1; each step moves all rows one level down one tree."""
        total, rows = np.full(len(x), self.bias), np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            while len(x) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: float = 5.0) -> Trees:
    """Boosted trees for the logistic loss; splits are sought among quantile bins of the features."""
    y = y.astype(float)
    mean = (y.sum() + 1) / (len(y) + 2)
    bias, inner = float(np.log(mean / (1 - mean))), (1 << depth) - 1
    feature, threshold, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    if not len(y) or y.min() == y.max():
        return Trees(bias, feature[:0], threshold[:0], value[:0])
    f = x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(f)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    cell = np.arange(f) * bins + binned
    total = np.full(len(y), bias)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            width, base = 1 << level, (1 << level) - 1
            at = ((node - base)[:, None] * (f * bins) + cell).ravel()
            gs, hs = (np.bincount(at, np.repeat(v, f), width * f * bins).reshape(width, f, bins).cumsum(2) for v in (g, h))
            ga, ha = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + l2) + (ga - gs) ** 2 / (ha - hs + l2) - ga**2 / (ha + l2)
            gain[(hs < least * 0.1) | (ha - hs < least * 0.1)] = -1
            best = gain.reshape(width, -1).argmax(1)
            for k, b in enumerate(best):
                j, cut_at = divmod(int(b), bins)
                if gain[k, j, cut_at] > 1e-9 and cut_at < len(edges[j]):
                    feature[t, base + k], threshold[t, base + k] = j, edges[j][cut_at]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] > threshold[t, node])
        leaf = node - inner
        value[t] = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + l2)
        total += value[t][leaf]
    return Trees(bias, feature, threshold, value)


def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = Powers()
    for batch in slices(batches):
        x = statistics(*flat(batch.column(0)), powers)
        lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], lists], names=["y", "x"])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, text: str = "text", doc_id: str = "doc_id", label: str = "quality") -> Trees:
    """Trees from at most max_rows labelled documents, those whose ids hash lowest.

    This bound is on the fitting sample only. Null labels and labels without a
    document are not used; without both classes the model is the constant rate.
    """
    sample = labels.where(col(label).isNotNull() & col(doc_id).isNotNull()).select(col(doc_id).alias("k"), col(label).cast("int").alias("y"))
    sample = F.broadcast(sample.orderBy(F.xxhash64("k"), "k", "y").limit(max_rows))
    rows = docs.select(col(doc_id).alias("d"), col(text).alias("t")).join(sample, F.col("d") == F.col("k")).select("t", "y")
    got = rows.mapInArrow(measured, "y int, x array<double>").toArrow()
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    y = got.column("y").to_numpy()
    order = np.lexsort([*x.T, y])
    return fit(x[order], y[order])


def predictor(model: Trees, threshold: float, at: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in slices(batches, at):
            score = model.score(statistics(*flat(batch.column(at)), powers))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array(score >= threshold)], names=[f"c{i}" for i in range(batch.num_columns + 2)])

    return run


def classify(docs: DataFrame, model: Trees, threshold: float = 0.5, text: str = "text", score: str = "score", keep: str = "keep") -> DataFrame:
    """docs with the probability of good quality and whether it reaches the threshold.

    Statistics are of each whole text (FEATURES); no shuffle. Null and empty texts
    have all statistics 0. Equal texts get equal scores. Extra columns stay; if
    one is named as a result column, the result's gets underscores before it. An
    empty table gives an empty table.
    """
    from pyspark.sql import types as T

    score, keep = fresh(docs, score, keep)
    fields = [T.StructField(f.name, f.dataType, True) for f in docs.schema.fields]
    schema = T.StructType([*fields, T.StructField(score, T.DoubleType()), T.StructField(keep, T.BooleanType())])
    return docs.mapInArrow(predictor(model, threshold, docs.columns.index(text)), schema)
