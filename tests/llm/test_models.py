import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftspark.llm import boosted, crf, ppm
from driftspark.llm.common import Powers, load

from .conftest import LONG, words


class Trie:
    """PPM with method C and exclusion by dictionaries, from grams with NUL before each text."""

    def __init__(self, texts):
        self.n = {}
        for t in texts:
            b = b"\0\0\0" + t
            for i in range(3, len(b)):
                for k in range(4):
                    node = self.n.setdefault(b[i - k : i], {})
                    node[b[i]] = node.get(b[i], 0) + 1

    def bits(self, text):
        b, total = b"\0\0\0" + text, 0.0
        for i in range(3, len(b)):
            out, s = set(), b[i]
            for k in (3, 2, 1, 0):
                seen = {x: c for x, c in self.n.get(b[i - k : i], {}).items() if x not in out}
                if not seen:
                    continue
                t, d = sum(seen.values()), len(seen)
                if s in seen:
                    total -= np.log2(seen[s] / (t + d))
                    break
                total -= np.log2(d / (t + d))
                out |= self.n[b[i - k : i]].keys()
            else:
                total += np.log2(256 - len(out))
        return total


@pytest.mark.parametrize("table_rows", [8_000_000, 0])
def test_code_lengths_agree_with_a_trie_of_dictionaries(spark, sf, table_rows):
    docs = load(spark, sf, "documents").where("n_chars < 1500").limit(60).persist()
    folds = {r.doc_id: (r.f, (r.text or "").encode()) for r in docs.select("doc_id", "text", (F.ascii(F.md5("text")) % 2).alias("f")).collect()}
    tries = [Trie([t for f, t in folds.values() if f == k]) for k in (0, 1)]
    got = {r.doc_id: r for r in ppm.ppm_score(docs, table_rows).collect()}
    for doc, (f, t) in folds.items():
        assert got[doc].n_bytes == len(t)
        assert abs(got[doc].bits - tries[1 - f].bits(t)) < 1e-3 * max(1, got[doc].bits)


def test_ppm_edge_cases(spark, messy, empty):
    rows = ppm.ppm_score(messy).collect()
    assert len(rows) == messy.count()
    for r in rows:
        assert (r.bits_per_byte is None) == (r.n_bytes == 0) and r.bits >= 0
    by = {r.doc_id: r for r in rows}
    assert by[7].n_bytes == len(LONG) and by[7].bits == by[8].bits
    assert ppm.ppm_score(empty).count() == 0
    one = ppm.ppm_score(spark.createDataFrame([(1, "abc")], "doc_id long, text string")).first()
    assert one.bits == 24


def test_score_tells_language_from_noise(spark, sf):
    docs = load(spark, sf, "documents").where("n_chars > 300").select("doc_id", "text")
    noise = docs.select((-F.col("doc_id") - 1).alias("doc_id"), F.substring(F.concat(F.sha2("text", 512), F.sha2(F.reverse("text"), 512)), 1, 256).alias("text")).limit(10)
    rows = ppm.ppm_score(docs.unionByName(noise)).collect()
    usual = np.median([r.bits_per_byte for r in rows if r.doc_id >= 0])
    assert usual < 4 and min(r.bits_per_byte for r in rows if r.doc_id < 0) > usual


def test_adaptive_code_learns():
    same, mixed = b"abcd" * 200, bytes(np.random.default_rng(0).integers(0, 256, 800, dtype=np.uint8))
    assert ppm.adaptive_bits(b"") == 0
    assert ppm.adaptive_bits(same) < 0.1 * 8 * len(same)
    assert ppm.adaptive_bits(mixed) > 0.9 * 8 * len(mixed)
    assert ppm.adaptive_bits(b"a") == 8


def test_adaptive_scores_of_a_table(messy, empty):
    rows = ppm.adaptive_score(messy.where("length(text) < 2000 or text is null"), order=2).collect()
    for r in rows:
        assert (r.bits_per_byte is None) == (r.n_bytes == 0)
    base = [r for r in rows if r.doc_id == 2]
    assert len(base) == 2 and base[0].bits == base[1].bits < 4 * base[0].n_bytes
    assert ppm.adaptive_score(empty).count() == 0


def brute_viterbi(field, score):
    best, out = -np.inf, None
    for labels in itertools.product((0, 1), repeat=len(score)):
        v = field.first[labels[0]] + sum(score[t] * y for t, y in enumerate(labels)) + sum(field.moves[a, b] for a, b in zip(labels, labels[1:]))
        if v > best:
            best, out = v, labels
    return best, out


def test_viterbi_agrees_with_all_labellings():
    rng = np.random.default_rng(5)
    for _ in range(20):
        field = crf.Field(rng.normal(size=3), rng.normal(size=2), rng.normal(size=(2, 2)), np.zeros(3), np.ones(3))
        sizes = rng.integers(0, 7, 6)
        offs = np.concatenate([[0], np.cumsum(sizes)])
        score = rng.normal(size=offs[-1])
        got = field.viterbi(score, offs)
        for a, b in zip(offs, offs[1:]):
            if b > a:
                assert tuple(got[a:b].astype(int)) == brute_viterbi(field, score[a:b])[1]


def test_field_learns_runs():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 200)
    sizes = rng.integers(1, 9, 200)
    offs = np.concatenate([[0], np.cumsum(sizes)])
    lab = np.repeat(y, sizes)
    x = np.stack([lab + rng.normal(scale=0.8, size=len(lab)), np.ones(len(lab))], 1)
    field = crf.fit(x, offs, lab)
    got = field.viterbi(field.scores(x), offs)
    alone = (x[:, 0] > 0.5).astype(int)
    assert (got == lab).mean() > 0.1 + (alone == lab).mean()


def brute_loss(theta, z, offs, label, l2):
    """Negative log likelihood a line by summing over all labellings."""
    w, first, moves = theta[:-6], theta[-6:-4], theta[-4:].reshape(2, 2)
    total = 0.0
    for a, b in zip(offs, offs[1:]):
        if a == b:
            continue
        score = z[a:b] @ w

        def value(labels):
            return first[labels[0]] + sum(s * y for s, y in zip(score, labels)) + sum(moves[p, q] for p, q in zip(labels, labels[1:]))

        total += np.logaddexp.reduce([value(c) for c in itertools.product((0, 1), repeat=b - a)]) - value(label[a:b].tolist())
    return total / offs[-1] + l2 / 2 * theta @ theta


def test_training_gradient_agrees_with_differences():
    rng = np.random.default_rng(8)
    offs = np.array([0, 4, 4, 9, 10, 16])
    z, label = rng.normal(size=(16, 3)), rng.integers(0, 2, 16)
    theta = rng.normal(size=9)
    loss, grad = crf.Chains(z, offs, label).loss(theta, 0.01)
    assert abs(loss - brute_loss(theta, z, offs, label, 0.01)) < 1e-9
    for k in range(9):
        step = np.eye(9)[k] * 1e-5
        want = (brute_loss(theta + step, z, offs, label, 0.01) - brute_loss(theta - step, z, offs, label, 0.01)) / 2e-5
        assert abs(grad[k] - want) < 1e-6


def test_long_documents_train_with_all_their_lines():
    parts, y = [np.arange(20.0).reshape(10, 2), np.zeros((3, 2)), np.ones((0, 2))], np.array([1, 0, 1])
    x, offs, label = crf.chained(parts, y, 4)
    assert np.diff(offs).tolist() == [4, 4, 2, 3, 7] and label.tolist() == [1] * 10 + [0] * 3 + [1] * 4 + [0] * 3
    assert (x[:10] == parts[0]).all() and (x[13:17] == parts[0][:4]).all()


@pytest.fixture(scope="module")
def halves(spark):
    big = "/root/testdata/sf0.01"
    labels = load(spark, big, "labels")
    return load(spark, big, "documents"), labels.where("doc_id % 2 = 0"), {r.doc_id: r.quality for r in labels.where("doc_id % 2 = 1").collect()}


def judged(rows, truth):
    got = [(r.keep, truth[r.doc_id]) for r in rows if r.doc_id in truth]
    good = [k for k, q in got if q == 1]
    bad = [k for k, q in got if q == 0]
    return np.mean(good), 1 - np.mean(bad)


def test_line_rules_on_labels_held_out(halves):
    docs, train, truth = halves
    kept, dropped = judged(crf.label_lines(docs, crf.train(docs, train)).collect(), truth)
    assert kept > 0.97 and dropped > 0.7, (kept, dropped)


def test_lines_of_spliced_documents_are_told_apart(halves):
    """A held-out good document joined to a bad one: both labels, and most lines right."""
    docs, train, truth = halves
    field = crf.train(docs, train)
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in truth and r.text and len(r.text.strip().split("\n")) > 1}
    good, bad = ([t for d, t in sorted(texts.items()) if truth[d] == q] for q in (1, 0))
    right, both, constant = [], [], []
    for k, (a, b) in enumerate(zip(good, bad)):
        parts = [(a.strip(), 1), (b.strip(), 0)] if k % 2 == 0 else [(b.strip(), 0), (a.strip(), 1)]
        data = np.frombuffer("\n".join(t for t, _ in parts).encode(), np.uint8)
        want = np.concatenate([np.full(sum(bool(words(x)) for x in t.split("\n")), v) for t, v in parts])
        x, _, offs = crf.lines(data, np.array([0, len(data)]), Powers())
        got = field.viterbi(field.scores(x), offs)
        right.append((got == want).mean())
        both.append(len(set(got)) == 2)
        constant.append(max(want.mean(), 1 - want.mean()))
    assert len(right) >= 10 and np.mean(both) > 0.85 and np.mean(right) > 0.9 > 0.1 + np.mean(constant), (len(right), np.mean(both), np.mean(right), np.mean(constant))


def test_line_rules_edge_cases(spark, messy, empty, halves):
    docs, train, _ = halves
    field = crf.train(docs, train)
    got = crf.label_lines(messy, field)
    assert got.columns == [*messy.columns, "n_lines", "content_lines", "content_share", "_keep"]
    rows = got.collect()
    assert len(rows) == messy.count()
    for r in rows:
        if not (r.text or "").strip():
            assert r.n_lines == 0 and r.content_share == 0 and not r._keep
    assert crf.kept(messy, field).columns == messy.columns
    assert crf.label_lines(empty, field).count() == 0
    plain = crf.train(empty, train)
    assert {r.keep for r in crf.label_lines(spark.createDataFrame([("some text",)], "text string"), plain).collect()} == {True}


def brute_score(model, row):
    total = model.bias
    for f, t, v in zip(model.feature, model.threshold, model.value):
        node = 0
        while node < len(f):
            node = 2 * node + (2 if row[f[node]] > t[node] else 1)
        total += v[node - len(f)]
    return 1 / (1 + np.exp(-total))


def test_flat_trees_agree_with_walking_one_row():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 5))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)
    model = boosted.fit(x, y, trees=40)
    score = model.score(x)
    assert np.allclose(score[:50], [brute_score(model, r) for r in x[:50]])
    assert ((score > 0.5) == y).mean() > 0.95
    assert len(boosted.fit(x, np.ones(600)).feature) == 0


def test_split_search_agrees_with_trying_every_split():
    """One tree of depth 2 against all features and all thresholds of the quantile bins."""
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(300, 4)), 1)
    y = ((x[:, 1] > 0.3) ^ (x[:, 2] > -0.2) ^ (rng.random(300) < 0.1)).astype(int)
    bins, l2 = 16, 1.0
    model = boosted.fit(x, y, trees=1, depth=2, bins=bins, l2=l2)
    p = (y.sum() + 1) / (len(y) + 2)
    g, h = p - y, np.full(len(y), p * (1 - p))

    def best(rows):
        found = (0.0, None)
        for j in range(x.shape[1]):
            for t in np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])):
                low = rows & (x[:, j] <= t)
                high = rows & ~low
                if h[low].sum() >= 0.5 and h[high].sum() >= 0.5:
                    gain = sum(s * g[r].sum() ** 2 / (h[r].sum() + l2) for s, r in ((1, low), (1, high), (-1, rows)))
                    if gain > found[0] + 1e-9:
                        found = (gain, (j, t))
        return found[1]

    everything = np.ones(len(y), bool)
    j, t = best(everything)
    nodes = [(everything, (j, t)), (x[:, j] <= t, best(x[:, j] <= t)), (x[:, j] > t, best(x[:, j] > t))]
    for k, (rows, split) in enumerate(nodes):
        assert (int(model.feature[0, k]), float(model.threshold[0, k])) == (split[0], float(split[1]))
    for k, (j, t) in enumerate(s for _, s in nodes[1:]):
        for side in (0, 1):
            rows = nodes[k + 1][0] & ((x[:, j] > t) == bool(side))
            assert np.isclose(model.value[0, 2 * k + side], -0.15 * g[rows].sum() / (h[rows].sum() + l2))


def test_classifier_on_labels_held_out(halves):
    docs, train, truth = halves
    kept, dropped = judged(boosted.classify(docs, boosted.train(docs, train)).collect(), truth)
    assert kept > 0.97 and dropped > 0.8, (kept, dropped)


def test_classifier_edge_cases(messy, empty, halves):
    docs, train, _ = halves
    model = boosted.train(docs, train)
    got = boosted.classify(messy, model)
    assert got.columns == [*messy.columns, "score", "_keep"]
    rows = got.collect()
    assert len(rows) == messy.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 2}) == 1
    assert boosted.classify(empty, model).count() == 0
    assert boosted.classify(messy, boosted.train(empty, train)).where("score = 0.5").count() == messy.count()


def test_statistics_of_empty_rows_are_zero():
    data = np.frombuffer(b"Some words. Some\nlines!", np.uint8)
    x = boosted.statistics(data, np.array([0, 0, len(data), len(data)]), Powers())
    assert (x[0] == 0).all() and (x[2] == 0).all() and np.isfinite(x).all()
    named = dict(zip(boosted.FEATURES, x[1]))
    assert named["lines"] == np.log1p(2) and named["distinct_words"] == 0.75 and named["top_word"] == 0.5
