import tempfile

import numpy as np
import pytest

from driftspark.llm import jaccard, suffix, suffix_dedup
from driftspark.llm.common import Powers, load

from .conftest import words


def brute_array(t):
    order = sorted(range(len(t)), key=lambda i: t[i:])
    lcp = [0]
    for a, b in zip(order, order[1:]):
        k = 0
        while t[a + k] == t[b + k]:
            k += 1
        lcp.append(k)
    return order, lcp


@pytest.mark.parametrize("chunk", [2, 3, 7, 50, 1 << 16])
def test_suffix_array_and_prefixes_agree_with_sorting(monkeypatch, chunk):
    monkeypatch.setattr(suffix, "CHUNK", chunk)
    monkeypatch.setattr(suffix, "SMALL", 4)
    rng = np.random.default_rng(chunk)
    for i in range(25):
        k = int(rng.choice([2, 3, 5, 30]))
        t = rng.integers(1, k, int(rng.integers(5, 150)))
        if i % 3 == 0:
            t = np.tile(t[: int(rng.integers(1, 9))], 20)
        t = np.append(t, 0).astype(np.uint16)
        with tempfile.TemporaryDirectory() as folder:
            sa, lcp = suffix.suffix_array(t, k + 1, folder)
            assert (sa.read()[::-1].tolist(), lcp.read()[::-1].tolist()) == brute_array(t.tolist())


def test_short_texts_are_sorted_in_memory():
    t = np.array([2, 1, 2, 1, 2, 1, 0])
    order, lcp = suffix.direct(t)
    assert (order.tolist(), lcp.tolist()) == brute_array(t.tolist())


def test_small_buckets_and_long_runs_are_taken_several_at_once(monkeypatch, tmp_path):
    """Neither each key of a large alphabet nor each symbol of a run costs a step of its own."""
    keys, steps = 5000, {"bucket": 0, "returning": 0}
    for name in steps:

        def counted(*args, name=name, run=getattr(suffix, name)):
            steps[name] += 1
            return run(*args)

        monkeypatch.setattr(suffix, name, counted)
    rng = np.random.default_rng(8)
    t = np.concatenate([rng.integers(1, keys, 10_000), np.full(3000, 77), rng.integers(1, keys, 10_000), [0]]).astype(np.uint16)
    sa, lcp = suffix.suffix_array(t, keys, str(tmp_path), 10_000)
    order, want = suffix.direct(t)
    assert (sa.read()[::-1] == order).all() and (lcp.read()[::-1] == want).all()
    assert max(steps.values()) < keys, steps


def brute_passages(rows, least):
    """Windows by dictionary; (doc_id, start, stop, first_doc, remove)."""
    at = {}
    for doc, text in sorted({(r.doc_id, r.text) for r in rows if r.doc_id is not None and r.text is not None}):
        w = words(text)
        for p in range(len(w) - least + 1):
            at.setdefault(tuple(w[p : p + least]), []).append((doc, p))
    marks = {}
    for places in at.values():
        if len(places) > 1:
            first = min(places)
            for doc, p in places:
                marks.setdefault((doc, first[0], (doc, p) != first), set()).add(p)
    out = []
    for (doc, first, remove), ps in marks.items():
        spans = []
        for p in sorted(ps):
            if spans and p <= spans[-1][1]:
                spans[-1][1] = p + least
            else:
                spans.append([p, p + least])
        out += [(doc, a, b, first, remove) for a, b in spans]
    return sorted(out)


def got_passages(df):
    return sorted((r.doc_id, r.start, r.stop, r.first_doc, r.remove) for r in df.collect())


@pytest.mark.parametrize(
    "least,options",
    [(50, {"small": 4}), (20, {"shard_words": 3000, "broadcast_rows": 0, "most_tasks": 3}), (50, {"anchored": False, "small": 1000})],
)
def test_passages_agree_with_brute_force(spark, sf, least, options):
    """By external sorting all the way down, over many shards a task, and without anchors."""
    docs = load(spark, sf, "documents")
    want = brute_passages(docs.collect(), least)
    assert want
    assert got_passages(suffix_dedup.repeated_passages(docs, least, **options)) == want


@pytest.mark.parametrize("size", [1, 2, 3, 17, 10_000])
def test_passes_do_not_depend_on_batches(size):
    import pyarrow as pa

    rng = np.random.default_rng(4)

    def batches(rows, names):
        for lo in range(0, len(rows), size):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[lo : lo + size])], names=names)

    def back(out):
        return [r for b in out for r in zip(*(c.to_pylist() for c in b.columns))]

    triples = sorted(zip(rng.integers(0, 40, 150).tolist(), rng.integers(0, 6, 150).tolist(), rng.integers(0, 4, 150).tolist()))
    by = {}
    for g, row, pos in triples:
        by.setdefault(g, set()).add((row, pos))
    assert back(suffix_dedup.repeated(batches(triples, ["g", "row", "pos"]))) == sorted((g, *x) for g, xs in by.items() if len(xs) > 1 for x in xs)
    placed = sorted({(int(r), int(p)): int(g) for r, p, g in zip(rng.integers(0, 9, 150), rng.integers(0, 4000, 150), rng.integers(0, 60, 150))}.items())
    rows = [(g, r, p) for (r, p), g in placed]
    whole = back(suffix_dedup.leaders(50)(iter([pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=["g", "row", "pos"])])))
    assert set(back(suffix_dedup.leaders(50)(batches(rows, ["g", "row", "pos"])))) == set(whole)
    shards = sorted((g % 3, r, p) for g, r, p in rows)
    shards.sort(key=lambda x: (x[1], x[0], x[2]))
    whole = back(suffix_dedup.stretches(50)(iter([pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*shards)], names=["shard", "row", "pos"])])))
    assert back(suffix_dedup.stretches(50)(batches(shards, ["shard", "row", "pos"]))) == whole and len(whole) == len({r for _, r, _ in shards})
    spans = sorted((int(d), int(d) + 100, int(f), bool(k), int(a), int(a + n)) for d, f, k, a, n in zip(rng.integers(0, 5, 200), rng.integers(0, 3, 200), rng.integers(0, 2, 200), rng.integers(0, 900, 200), rng.integers(50, 90, 200)))
    want = []
    for s in spans:
        if want and want[-1][:4] == list(s[:4]) and s[4] <= want[-1][5]:
            want[-1][5] = max(want[-1][5], s[5])
        else:
            want.append(list(s))
    assert back(suffix_dedup.merged(batches(spans, [x.split()[0] for x in suffix_dedup.SPANS.split(", ")]))) == [tuple(x) for x in want]


def test_passages_edge_cases(messy, empty):
    want = brute_passages(messy.collect(), 50)
    assert got_passages(suffix_dedup.repeated_passages(messy)) == want
    assert suffix_dedup.repeated_passages(empty).count() == 0


@pytest.mark.parametrize("most", [1 << 22, 10])
def test_a_shards_memory_does_not_grow_with_it(tmp_path, monkeypatch, most):
    """One passage of 60 words in many documents with surroundings of their own, in one shard."""
    import tracemalloc

    monkeypatch.setattr(suffix_dedup, "CHUNK", 1 << 11)
    monkeypatch.setattr(suffix_dedup, "VOCABULARY", most, raising=False)
    rng, n, own, shared = np.random.default_rng(3), 6000, 10, 60
    words = rng.integers(0, 1 << 32, (n, own + shared), dtype=np.uint32)
    words[:, : own // 2] %= 1000
    words[:, own:] = words[0, own:]
    owner = np.concatenate([np.arange(n), [5, 0, 5]])  # three more are copies
    doc, row, at = 10 + rng.permutation(len(owner)), rng.permutation(len(owner)), rng.integers(0, 9, len(owner))
    peaks, build = [], suffix.suffix_array

    def watched(*args):
        peaks.append(tracemalloc.get_traced_memory()[1])
        out = build(*args)
        tracemalloc.reset_peak()
        return out

    monkeypatch.setattr(suffix_dedup, "suffix_array", watched)
    got = set()
    tracemalloc.start()
    held = 0
    for cols in suffix_dedup.passages(words.ravel(), np.full(n, own + shared), owner, doc, row, at, 50, str(tmp_path)):
        peaks.append(tracemalloc.get_traced_memory()[1] - held)
        before = tracemalloc.get_traced_memory()[0]
        for d, r, f, gone, a, b in zip(*(x.tolist() for x in cols)):
            got |= {(d, r, f, gone, p) for p in range(a, b - 49)}
        held += tracemalloc.get_traced_memory()[0] - before
        tracemalloc.reset_peak()
    tracemalloc.stop()
    whole = {o: {p for p in range(own, own + shared - 49)} | (set(range(own)) if (owner == o).sum() > 1 else set()) for o in range(n)}
    want = set()
    for i, o in enumerate(owner.tolist()):
        for p in whole[o]:
            rivals = np.arange(len(owner)) if p >= own else np.flatnonzero(owner == o)
            first = rivals[np.argmin(doc[rivals])]
            want.add((int(doc[i]), int(row[i]), int(doc[first]), bool(i != first), int(at[i]) + p))
    assert got == want
    assert max(peaks) < 6 << 20


def test_folder_must_be_a_path(spark):
    with pytest.raises(ValueError):
        suffix_dedup.shared_folder(spark, "hdfs://somewhere/else")


def ngrams(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}


def brute_pairs(rows, least, n):
    docs = sorted({(r.doc_id, r.text) for r in rows if r.doc_id is not None and r.text is not None})
    sets = [(d, ngrams(t, n)) for d, t in docs]
    out = {}
    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            if a != b and x and y:
                j = len(x & y) / len(x | y)
                if j >= least:
                    out[a, b] = max(j, out.get((a, b), 0))
    return out


@pytest.mark.parametrize("chunk,broadcast", [(1 << 24, 2_000_000), (4000, 0)])
def test_pairs_agree_with_brute_force(spark, sf, chunk, broadcast):
    docs = load(spark, sf, "documents")
    want = brute_pairs(docs.collect(), 0.5, 3)
    got = {(r.doc_a, r.doc_b): r.jaccard for r in jaccard.similar_pairs(docs, chunk_bytes=chunk, broadcast_rows=broadcast).collect()}
    assert len(want) > 10
    assert set(got) <= set(want) and {k for k, v in want.items() if v >= 0.55} <= set(got) and len(got) >= 0.98 * len(want)
    assert all(abs(v - want[k]) < 1e-12 for k, v in got.items())


def planted_pairs(n, seed):
    """Texts 2i and 2i + 1 share the first words, so that 3-gram Jaccard similarities go from 0.5 to 0.7."""
    rng = np.random.default_rng(seed)
    for i in range(n):
        size = int(rng.integers(30, 400))
        shared = int(np.ceil((0.5 + 0.2 * i / n) * 2 * size / (1.5 + 0.2 * i / n)))
        a = [f"w{x}" for x in rng.integers(0, 1 << 40, size + 2)]
        b = a[: shared + 2] + [f"v{x}" for x in rng.integers(0, 1 << 40, size - shared)]
        yield (2 * i, " ".join(a))
        yield (2 * i + 1, " ".join(b))


def test_few_pairs_just_above_the_threshold_are_missed(spark):
    n = 1500
    docs = spark.createDataFrame(list(planted_pairs(n, 1)), "doc_id long, text string").repartition(4)
    got = {(r.doc_a, r.doc_b): r.jaccard for r in jaccard.similar_pairs(docs).collect()}
    assert all(a % 2 == 0 and b == a + 1 for a, b in got)
    level = {i: 0.5 + 0.2 * i / n for i in range(n)}
    found = lambda lo, hi: np.mean([(2 * i, 2 * i + 1) in got for i, j in level.items() if lo <= j < hi])
    assert found(0.5, 0.52) > 0.96 and found(0.55, 0.7) > 0.995, (found(0.5, 0.52), found(0.55, 0.7))


def brute_parts(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {x: find(x) for x in up}


def classes(ids, pairs):
    roots, links = brute_parts(pairs), {}
    for p in pairs:
        for x in p:
            links[x] = links.get(x, 0) + 1
    return sorted((i, roots.get(i, i), links.get(i, 0)) for i in ids)


def test_classes_say_what_the_pairs_do_in_a_row_a_document(spark):
    """Copies by the hundred, near copies, and ids with several texts, some of them shared."""
    words = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join(words)) for k in range(100, 200)] + [(k, " ".join(words + [f"a{k}"])) for k in range(6)]
    rows += [(k, f"another text {'of some words ' * 4} but the last") for k in (500, 501, 7)] + [(500, " ".join(words[:50])), (502, " ".join(words[:50])), (503, "alone here and now")]
    rows += [(k, t) for k in (600, 601) for t in ("first of two texts", "second of two texts here")] + [(602, "second of two texts here"), (603, None), (None, "alone here and now")]
    made = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    ids = {r.doc_id for r in made.collect()} - {None}
    got = jaccard.similar_classes(made)
    assert got.columns == ["doc_id", "class_id", "n_links"]
    assert sorted(tuple(r) for r in got.collect()) == classes(ids, brute_pairs(made.collect(), 0.5, 3))


@pytest.mark.parametrize("chunk,broadcast", [(1 << 24, 2_000_000), (1500, 0), (6000, 2_000_000)])
def test_links_connect_what_the_pairs_do(spark, sf, messy, chunk, broadcast):
    """Also where one key gathers a large group, a small one and single texts, over many chunks."""
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(90):  # a large group, each next to a core
        rows.append((1000 + k, " ".join(words[:60] + [f"a{k}"])))
    for k in range(12):  # a small one that shares a good deal with the large one
        rows.append((2000 + k, " ".join(words[:38] + [f"b{i}" for i in range(20)] + [f"c{k}"])))
    for k in range(10):
        rows.append((3000 + k, " ".join(words[:35] + [f"d{x}" for x in rng.integers(0, 1 << 30, 35)])))
    rows.append((4000, " ".join(words[:50] + [f"b{i}" for i in range(20)])))
    made = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for docs in (made, load(spark, sf, "documents"), messy):
        pairs = jaccard.similar_pairs(docs, chunk_bytes=chunk).collect()
        links = jaccard.similar_links(docs, chunk_bytes=chunk, broadcast_rows=broadcast).collect()
        assert {(r.doc_a, r.doc_b) for r in links} <= {(r.doc_a, r.doc_b) for r in pairs}
        assert brute_parts((r.doc_a, r.doc_b) for r in links) == brute_parts((r.doc_a, r.doc_b) for r in pairs)
        if docs is made:
            assert len(pairs) > 4000 and (len(links) < 130 if chunk > 1 << 20 else len(links) < 1500)


@pytest.mark.parametrize("size", [1, 2, 5, 1000])
def test_links_by_key_do_not_depend_on_batches(size):
    import pyarrow as pa

    rng = np.random.default_rng(size)
    rows = sorted(zip(rng.integers(0, 30, 80).tolist(), rng.integers(0, 12, 80).tolist()))
    batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[lo : lo + size])], names=["key", "t"]) for lo in range(0, len(rows), size)]
    got = [r for b in jaccard.linked(batches) for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    by = {}
    for k, t in rows:
        by.setdefault(k, set()).add(t)
    assert sorted(got) == sorted((min(ts), t) for ts in by.values() if len(ts) > 1 for t in ts)


def test_pairs_edge_cases(messy, empty):
    want = brute_pairs(messy.collect(), 0.5, 3)
    got = {(r.doc_a, r.doc_b): r.jaccard for r in jaccard.similar_pairs(messy).collect()}
    assert got == want and (1, 2) in got and (7, 8) in got
    assert jaccard.similar_pairs(empty).count() == 0
    kept = jaccard.one_of_each(messy)
    assert kept.columns == messy.columns
    ids = sorted(r.doc_id or 0 for r in kept.collect())
    assert ids == [0, 0, 1, 4, 5, 6, 7, 9, 9, 10, 11, 12]
    assert jaccard.one_of_each(empty).count() == 0


def test_rtree_bounds_lose_nothing():
    rng = np.random.default_rng(3)
    base = [np.unique(rng.integers(0, 2**48, rng.integers(5, 200), dtype=np.uint64)) for _ in range(40)]
    items = base + [np.unique(np.concatenate([x[: int(len(x) * 0.8)], rng.integers(0, 2**48, 5, dtype=np.uint64)])) for x in base for _ in range(6)]
    want = {(i, j) for i in range(len(items)) for j in range(i + 1, len(items)) if len(np.intersect1d(items[i], items[j])) / len(np.union1d(items[i], items[j])) >= 0.6}
    yes = np.ones(len(items), bool)
    got = {(int(a), int(b)) for x, y, _ in jaccard.search(np.arange(len(items)), items, yes, yes, 0.6) for a, b in zip(x, y)}
    assert got == want and len(want) > 100


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, k) for k in range(101, 130)] + [(5, 5)]
    got = {r.node: r.root for r in jaccard.components(spark.createDataFrame(edges, "doc_a long, doc_b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 21)}, **{k: 100 for k in range(101, 130)}}
