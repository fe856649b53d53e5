"""Quality rules: lines labelled content or boilerplate by a linear-chain conditional random field."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .boosted import _sums, runs
from .common import Powers, col, flat, fold_case, fresh, slices, span_hashes, spans

FEATURES = "log_bytes log_words word_length upper digits marks wide symbols_end capital_start full_stop distinct_words repeated bars short bias".split()


def lines(data: np.ndarray, offs: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and bytes of all lines that are not blank, and each row's line offsets."""
    breaks = np.flatnonzero(data == 10)
    cuts = np.unique(np.concatenate([offs, breaks + 1]))
    cuts = cuts[cuts <= len(data)]
    if len(cuts) < 2:
        return np.zeros((0, len(FEATURES))), np.zeros(0), np.zeros(len(offs), np.int64)
    starts, ends, woffs = spans(data, cuts)
    words = np.diff(woffs)
    full = words > 0
    begin, size = cuts[:-1][full], np.diff(cuts)[full].astype(float)
    lrow = np.searchsorted(offs, begin, "right") - 1
    upper = (data >= 65) & (data <= 90)
    digit = (data >= 48) & (data <= 57)
    wide = data >= 128
    plain = upper | digit | wide | ((data >= 97) & (data <= 122)) | (data <= 32)
    w = np.repeat(np.arange(len(words)), words)
    h = span_hashes(fold_case(data), starts, ends, powers)
    last = data[ends - 1]
    symbol = np.isin(last, np.frombuffer(b"!#$%&*+<=>@^_|~", np.uint8))
    distinct = runs(w, h, len(words))[0][full]
    n = words[full].astype(float)
    final = last[woffs[1:][full] - 1]
    whole = span_hashes(data, starts[woffs[:-1][full]], ends[woffs[1:][full] - 1], powers)
    key = whole ^ (lrow.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
    x = np.stack([
        np.log1p(size), np.log1p(n), np.bincount(w, ends - starts, len(words))[full] / n, _sums(upper, cuts)[full] / size, _sums(digit, cuts)[full] / size,
        _sums(~plain, cuts)[full] / size, _sums(wide, cuts)[full] / size, np.bincount(w, symbol, len(words))[full] / n, upper[starts[woffs[:-1][full]]].astype(float),
        np.isin(final, [33, 46, 63]).astype(float), distinct / n, (times[inverse] > 1).astype(float), _sums(data == 124, cuts)[full] / n, (n < 4).astype(float), np.ones(len(n)),
    ], 1)
    return x, size, np.searchsorted(begin, offs)


class Field:
    """A chain of labels 0 (boilerplate) and 1 (content): weights of label 1, first label, transitions."""

    def __init__(self, weights: np.ndarray, first: np.ndarray, moves: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> None:
        self.weights, self.first, self.moves, self.mean, self.scale = weights, first, moves, mean, scale

    def scores(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def viterbi(self, score: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """The most probable labels of all rows' chains, all rows moving one line at a time; a tie is content."""
        size = np.diff(offs)
        order = np.argsort(-size, kind="stable")
        start, size = offs[:-1][order], size[order]
        back, out = np.zeros((len(score), 2), bool), np.zeros(len(score), bool)
        if not len(score):
            return out
        live = int((size > 0).sum())
        best = np.stack([np.full(live, self.first[0]), self.first[1] + score[start[:live]]], 1)
        final = np.zeros(len(size), bool)
        for t in range(1, int(size[0]) + 1):
            more = int(np.searchsorted(-size, -t, "left"))
            final[more:live] = best[more:live, 1] >= best[more:live, 0]
            live = more
            if not live:
                break
            at, b = start[:live] + t, best[:live]
            from0, from1 = b[:, 0:1] + self.moves[0], b[:, 1:2] + self.moves[1]
            back[at] = from1 >= from0
            best = np.maximum(from0, from1)
            best[:, 1] += score[at]
        live = int((size > 0).sum())
        state = final[:live].copy()
        for t in range(int(size[0]) - 1, -1, -1):
            live = int(np.searchsorted(-size, -t, "left"))
            at = start[:live] + t
            out[at] = state[:live]
            if t:
                state[:live] = np.where(state[:live], back[at, 1], back[at, 0])
        return out


class Chains:
    """Lines of chains with known labels, arranged so that all chains move one line at a time."""

    def __init__(self, z: np.ndarray, offs: np.ndarray, label: np.ndarray) -> None:
        size = np.diff(offs)
        keep = np.flatnonzero(size > 0)
        keep = keep[np.argsort(-size[keep], kind="stable")]
        self.z, self.label, self.start, self.size = z, label.astype(int), offs[:-1][keep], size[keep]
        self.live = [int(np.searchsorted(-self.size, -t, "left")) for t in range(int(self.size[0]))]
        self.at = np.concatenate([np.arange(s, s + n) for s, n in zip(self.start, self.size)])
        follows = np.ones(len(z), bool)
        follows[offs[:-1][size > 0]] = False
        to = np.flatnonzero(follows)
        self.moves = np.bincount(2 * self.label[to - 1] + self.label[to], minlength=4)

    def loss(self, theta: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
        """Negative log likelihood a line and its gradient, with a quadratic penalty."""
        z, start, size, live, at_all = self.z, self.start, self.size, self.live, self.at
        w, first, moves = theta[:-6], theta[-6:-4], theta[-4:].reshape(2, 2)
        e = np.stack([np.zeros(len(z)), z @ w], 1)
        alpha, beta = np.zeros((len(z), 2)), np.zeros((len(z), 2))
        alpha[start] = first + e[start]
        for t in range(1, len(live)):
            at = start[: live[t]] + t
            alpha[at] = np.logaddexp(alpha[at - 1, 0:1] + moves[0], alpha[at - 1, 1:2] + moves[1]) + e[at]
        pair = np.zeros((2, 2))
        norm = np.logaddexp(*alpha[start + size - 1].T)
        for t in range(len(live) - 1, 0, -1):
            at = start[: live[t]] + t
            right = beta[at] + e[at]
            beta[at - 1] = np.logaddexp(moves[:, 0] + right[:, 0:1], moves[:, 1] + right[:, 1:2])
            joint = alpha[at - 1][:, :, None] + moves + right[:, None, :] - norm[: live[t], None, None]
            pair += np.exp(joint).sum(0)
        p1 = np.zeros(len(z))
        p1[at_all] = np.exp(alpha[at_all, 1] + beta[at_all, 1] - np.repeat(norm, size))
        y, seen, total = self.label[start], self.moves, float(size.sum())
        g_first = np.array([(1 - p1[start]).sum() - (y == 0).sum(), p1[start].sum() - (y == 1).sum()])
        known = self.label[at_all] @ e[at_all, 1] + first[y].sum() + seen @ moves.ravel()
        grad = np.concatenate([z[at_all].T @ (p1 - self.label)[at_all], g_first, pair.ravel() - seen])
        return (norm.sum() - known) / total + l2 / 2 * theta @ theta, grad / total + l2 * theta


def fit(x: np.ndarray, offs: np.ndarray, label: np.ndarray, rounds: int = 80, rate: float = 0.15, l2: float = 1e-3) -> Field:
    """The field of highest likelihood for chains whose lines have the labels, by Adam on exact gradients."""
    mean, scale = x.mean(0), x.std(0)
    mean[-1], scale[scale < 1e-9] = 0, 1
    chains = Chains((x - mean) / scale, offs, label)
    theta = np.zeros(len(mean) + 6)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for r in range(1, rounds + 1):
        grad = chains.loss(theta, l2)[1]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta - rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-9)
    return Field(theta[:-6], theta[-6:-4], theta[-4:].reshape(2, 2), mean, scale)


def chained(parts: list[np.ndarray], y: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines, chain offsets and line labels of the fitting sample.

    Each document is a chain of its own label, or several of at most `most` lines
    one after another. Then the k-th document of one label is joined to the k-th
    of the other, the good one first for even k, so the field also sees labels change.
    """
    cut = [(p[lo : lo + most], v) for p, v in zip(parts, y) for lo in range(0, len(p), most)]
    chains = [[c] for c in cut]
    good, bad = ([c for c in cut if c[1] == v] for v in (1, 0))
    chains += [[a, b] if k % 2 == 0 else [b, a] for k, (a, b) in enumerate(zip(good, bad))]
    x = np.concatenate([p for c in chains for p, _ in c])
    label = np.concatenate([np.full(len(p), v) for c in chains for p, v in c])
    return x, np.concatenate([[0], np.cumsum([sum(len(p) for p, _ in c) for c in chains])]), label


def train(docs: DataFrame, labels: DataFrame, max_docs: int = 4000, chain_lines: int = 400, text: str = "text", doc_id: str = "doc_id", label: str = "quality") -> Field:
    """A field from at most max_docs labelled documents, those whose ids hash lowest.

    The bound is on the fitting sample only. A document's label stands for each
    of its lines; chained() adds joined documents, where labels change. A
    document of more than chain_lines lines is fitted as several chains of all
    its lines. Null labels and labels without a document are not used. Without
    both classes, all lines are content.
    """
    sample = labels.where(col(label).isNotNull() & col(doc_id).isNotNull()).select(col(doc_id).alias("k"), (col(label) > 0).cast("int").alias("y"))
    sample = F.broadcast(sample.orderBy(F.xxhash64("k"), "k", "y").limit(max_docs))
    rows = docs.select(col(doc_id).alias("d"), col(text).alias("t")).join(sample, F.col("d") == F.col("k")).select("t", "y")
    width = len(FEATURES)
    got = rows.mapInArrow(measured, "y int, x array<double>").toArrow()
    y = got.column("y").to_numpy()
    parts = [np.array(v, float).reshape(-1, width) for v in got.column("x").to_pylist()]
    order = sorted(range(len(parts)), key=lambda i: (parts[i].tobytes(), y[i]))
    y, parts = y[order] if len(y) else y, [parts[i] for i in order]
    used = {int(v) for v, p in zip(y, parts) if len(p)}
    if used != {0, 1}:
        w = np.zeros(width)
        w[-1] = 1
        return Field(w, np.zeros(2), np.zeros((2, 2)), np.zeros(width), np.ones(width))
    return fit(*chained(parts, y, chain_lines))


def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = Powers()
    for batch in slices(batches):
        x, _, offs = lines(*flat(batch.column(0)), powers)
        lists = [x[a:b].ravel() for a, b in zip(offs, offs[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(lists, pa.list_(pa.float64()))], names=["y", "x"])


def labeller(field: Field, least: float, at: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in slices(batches, at):
            x, size, offs = lines(*flat(batch.column(at)), powers)
            content = field.viterbi(field.scores(x), offs)
            row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
            n = len(offs) - 1
            share = np.bincount(row, size * content, n) / np.maximum(np.bincount(row, size, n), 1)
            new = [pa.array(np.diff(offs)), pa.array(np.bincount(row, content, n).astype(np.int64)), pa.array(share), pa.array((share >= least) & (np.diff(offs) > 0))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[f"c{i}" for i in range(batch.num_columns + 4)])

    return run


def label_lines(docs: DataFrame, field: Field, least: float = 0.5, text: str = "text", names: tuple[str, str, str, str] = ("n_lines", "content_lines", "content_share", "keep")) -> DataFrame:
    """docs with the number of lines, of content lines, the content's share of bytes, and whether it reaches least.

    Each whole text is split at line feeds; blank lines do not count. Viterbi
    decoding labels the lines of a text together. No shuffle.

    Null, empty and blank texts have no lines, share 0, and are not kept. Equal
    texts get equal results; a tie between labels is content. Extra columns stay;
    if one is named as a result column, the result's gets underscores before it.
    An empty table gives an empty table.
    """
    new = fresh(docs, *names)
    fields = [T.StructField(f.name, f.dataType, True) for f in docs.schema.fields]
    kinds = [T.LongType(), T.LongType(), T.DoubleType(), T.BooleanType()]
    schema = T.StructType([*fields, *[T.StructField(c, k) for c, k in zip(new, kinds)]])
    return docs.mapInArrow(labeller(field, least, docs.columns.index(text)), schema)


def kept(docs: DataFrame, field: Field, least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of docs that label_lines keeps, with the columns of docs alone."""
    marked = label_lines(docs, field, least, text)
    return marked.where(col(marked.columns[-1])).select(*[col(c) for c in docs.columns])
