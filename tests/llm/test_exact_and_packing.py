import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from driftspark.llm import bloom_dedup, mixing, packing
from driftspark.llm.common import Powers, load, span_hashes, spans

from .conftest import words


def test_words_of_bytes_agree_with_splitting():
    texts = ["", "a b", " lead", "trail ", "x\n\ty z", "é à", "one"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    starts, ends, woffs = spans(data, offs)
    got = [[bytes(data[s:e]) for s, e in zip(starts[a:b], ends[a:b])] for a, b in zip(woffs, woffs[1:])]
    assert got == [words(t) for t in texts]
    h = span_hashes(data, starts, ends, Powers())
    flat = [w for r in got for w in r]
    assert len(set(h.tolist())) == len(set(flat))


def test_bloom_has_no_false_negatives():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 20_000, dtype=np.uint64)
    b = bloom_dedup.Bloom(20_000)
    b.add(h)
    assert b.has(h).all()
    assert b.has(rng.integers(0, 2**63, 20_000, dtype=np.uint64)).mean() < 0.05


@pytest.mark.parametrize("broadcast", [4_000_000, 0])
def test_exact_dedup_keeps_the_first_of_each_text(spark, sf, messy, broadcast):
    for docs in (messy, load(spark, sf, "documents")):
        rows = docs.collect()
        best = {}
        for r in rows:
            k = (r.doc_id is None, r.doc_id or 0)
            if r.text is not None and (r.text not in best or k < best[r.text]):
                best[r.text] = k
        got = bloom_dedup.exact_dedup(docs, broadcast_keys=broadcast)
        assert got.columns == docs.columns
        out = got.collect()
        assert sum(r.text is None for r in out) == sum(r.text is None for r in rows)
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in out if r.text is not None) == sorted(best.values())
        assert len({r.text for r in out}) == len({r.text for r in rows})


def test_exact_dedup_of_nothing(empty):
    assert bloom_dedup.exact_dedup(empty).count() == 0


class Slow:
    """Best fit by looking at every open bin."""

    def __init__(self, capacity, most):
        self.capacity, self.most, self.open, self.made = capacity, most, [], 0

    def put(self, n):
        fits = [b for b in self.open if b[0] >= n]
        if fits:
            free = min(b[0] for b in fits)
            b = [b for b in fits if b[0] == free][-1]
            self.open.remove(b)
        else:
            if len(self.open) == self.most and n < self.capacity:
                free = min(b[0] for b in self.open)
                self.open.remove([b for b in self.open if b[0] == free][-1])
            b = (self.capacity, self.made, 0)
            self.made += 1
        if b[0] > n:
            self.open.append((b[0] - n, b[1], b[2] + 1))
        return b[1], b[2]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=120), st.integers(1, 6))
def test_best_fit_agrees_with_looking_at_every_bin(sizes, most):
    fast, slow = packing.BestFit(20, most), Slow(20, most)
    assert [fast.put(n) for n in sizes] == [slow.put(n) for n in sizes]


def test_a_full_piece_closes_no_bin():
    fit = packing.BestFit(10, 1)
    assert [fit.put(n) for n in (6, 10, 4)] == [(0, 0), (1, 0), (0, 1)]


def test_packing_places_every_word_once(spark, sf, messy):
    for docs, capacity in ((messy, 50), (load(spark, sf, "documents"), 256)):
        rows = packing.best_fit_pack(docs, capacity=capacity, open_bins=4, shard_tokens=20_000).collect()
        used, per = {}, {}
        for r in rows:
            if r.length:
                used[r.shard, r.bin] = used.get((r.shard, r.bin), 0) + r.length
            else:
                assert r.bin is None and r.slot is None
            per.setdefault(r.doc_id, []).append((r.start, r.length))
        assert max(used.values()) <= capacity
        want = {}
        for r in docs.collect():
            want[r.doc_id] = want.get(r.doc_id, 0) + len((r.text or "").split())
        # str.split also splits at wide spaces; the one text with such is left out
        assert {k: sum(n for _, n in v) for k, v in per.items() if k != 10} == {k: v for k, v in want.items() if k != 10}
        slots = [(r.shard, r.bin, r.slot) for r in rows if r.length]
        assert len(slots) == len(set(slots))


def test_packing_does_not_depend_on_partitions(spark, sf):
    docs = load(spark, sf, "documents")
    a = packing.best_fit_pack(docs.repartition(7), shard_tokens=30_000).collect()
    b = packing.best_fit_pack(docs.coalesce(1), shard_tokens=30_000).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_packing_of_nothing(empty):
    assert packing.best_fit_pack(empty).count() == 0


def shares(rows, column, value):
    total = {}
    for r in rows:
        total[r[column]] = total.get(r[column], 0) + r["n_tokens"] * r[value]
    return {k: v / sum(total.values()) for k, v in total.items()}


def test_mixing_meets_all_targets_like_iterative_fitting(spark, sf):
    docs = load(spark, sf, "documents")
    sources = sorted(r[0] for r in docs.select("source").distinct().collect())
    targets = {"source": {s: (i + 1) / sum(range(1, len(sources) + 1)) for i, s in enumerate(sources)}, "lang": {"en": 0.4, "de": 0.3}}
    rows = mixing.mix_to_targets(docs, targets).collect()
    by_source, by_lang = shares(rows, "source", "rate"), shares(rows, "lang", "rate")
    assert all(abs(by_source[s] - p) < 1e-6 for s, p in targets["source"].items())
    assert abs(by_lang["en"] - 0.4) < 1e-6 and abs(by_lang["de"] - 0.3) < 1e-6
    # brute force: alternate scaling of margins converges to the same rates
    n = np.array([r.n_tokens for r in rows], float)
    s = np.array([sources.index(r.source) for r in rows])
    g = np.array([{"en": 0, "de": 1}.get(r.lang, 2) for r in rows])
    w, ts, tg = np.ones(len(rows)), np.array([targets["source"][x] for x in sources]) * n.sum(), np.array([0.4, 0.3, 0.3]) * n.sum()
    for _ in range(500):
        w *= (ts / np.bincount(s, w * n))[s]
        w *= (tg / np.bincount(g, w * n))[g]
    assert np.allclose(w, [r.rate for r in rows], rtol=1e-5)
    assert all(np.floor(r.rate) <= r.copies <= np.ceil(r.rate) for r in rows)
    assert abs(sum(r.copies * r.n_tokens for r in rows) / n.sum() - 1) < 0.25


def test_mixing_edge_cases(messy, empty):
    targets = {"source": mixing.temper(mixing.word_counts(messy, ["source"]), "source", 0.7), "lang": {"en": 0.5, "xx": 0.2}}
    got = mixing.mix_to_targets(messy, targets, keep_all=True)
    assert got.columns == [*messy.columns, "_rate", "copies", "n_tokens"]
    rows = got.collect()
    assert len(rows) == messy.count()
    assert all(r.copies >= 1 for r in rows)
    twins = [r for r in rows if r.doc_id == 2]
    assert len({r.copies for r in twins}) == 1
    assert mixing.mix_to_targets(empty, targets).count() == 0
    assert mixing.temper(mixing.word_counts(empty, ["source"]), "source", 0.5) == {}
    blank = messy.where(F.col("text").isNull() | (F.length(F.trim("text")) == 0))
    assert mixing.mix_to_targets(blank, {"source": mixing.temper(mixing.word_counts(blank, ["source"]), "source", 0.5)}).count() == blank.count()


def test_a_share_of_zero_leaves_out(spark, sf):
    docs = load(spark, sf, "documents")
    rows = mixing.mix_to_targets(docs, {"lang": {"en": 1.0}}).collect()
    assert all((r.rate > 0) == (r.lang == "en") for r in rows)
    assert all(r.copies == 0 for r in rows if r.lang != "en")


def test_rare_sources_are_levels_of_their_own(spark):
    """Over a thousand sources below 0.1 % of the words, of three sizes, beside two large ones."""
    sizes = {f"rare{i}": 1 + i % 3 for i in range(1200)} | {"big": 9000, "hot": 20_000, None: 7}
    rows = [(i, "w " * (n // 2 if lang == "en" else n - n // 2), s, lang) for i, ((s, n), lang) in enumerate((x, g) for x in sizes.items() for g in ("en", "de"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(3)
    counts = mixing.word_counts(docs, ["source", "lang"])
    target = mixing.temper(counts, "source", 0.7)
    total = sum(n**0.7 for n in sizes.values())
    assert target.keys() == {mixing.OTHER if s is None else s for s in sizes}
    assert all(abs(target[mixing.OTHER if s is None else s] / (n**0.7 / total) - 1) < 1e-9 for s, n in sizes.items())
    got = mixing.mix_to_targets(docs, {"source": target, "lang": {"en": 0.4}}, counts=counts).collect()
    by_source, by_lang = shares(got, "source", "rate"), shares(got, "lang", "rate")
    assert all(abs(by_source[s] / (n**0.7 / total) - 1) < 1e-6 for s, n in sizes.items())
    assert abs(by_lang["en"] - 0.4) < 1e-6
