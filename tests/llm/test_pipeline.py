from pathlib import Path

import corpus_pipeline
from driftspark.llm import crf, jaccard, queries
from driftspark.llm.common import checkpoint_dir, load

from .test_passages_and_pairs import brute_pairs


def test_stages_one_by_one(spark, sf, tmp_path):
    docs = load(spark, sf, "documents")
    outs = []
    current = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, current, sf).write.parquet(str(tmp_path / str(k)))
        outs.append(spark.read.parquet(str(tmp_path / str(k))))
        current = outs[-1]
    assert all(o.columns == docs.columns for o in outs[:-1])
    rules, exact, near, mixed, packed = (o.collect() for o in outs)
    # rules: what the field says line by line
    field = crf.train(docs, load(spark, sf, "labels"))
    assert {r.doc_id for r in rules} == {r.doc_id for r in crf.label_lines(docs, field).where("keep").collect()}
    # exact dedup: the least id of each text
    first = {}
    for r in rules:
        first[r.text] = min(r.doc_id, first.get(r.text, r.doc_id))
    assert {r.doc_id for r in exact} == set(first.values())
    # near dedup: the least id of each component of all similar pairs
    root = {r.doc_id: r.doc_id for r in exact}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in brute_pairs(exact, 0.5, 3):
        a, b = sorted((find(a), find(b)))
        root[b] = a
    assert {r.doc_id for r in near} == {x for x in root if find(x) == x}
    # mixing: nothing lost, rare sources more often
    assert {r.doc_id for r in mixed} == {r.doc_id for r in near} and len(mixed) >= len(near)
    # packing: every word of every copy
    want = {}
    for r in mixed:
        want[r.doc_id] = want.get(r.doc_id, 0) + len(r.text.split())
    got = {}
    for r in packed:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want


def test_run_is_the_stages(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    assert rows and {r.doc_id for r in rows} <= {r.doc_id for r in load(spark, sf, "documents").collect()}
    left = [p for p in Path(checkpoint_dir(spark).removeprefix("file:")).glob("pipeline-*")]
    assert left and all(sorted(x.name for x in p.iterdir() if not x.name.startswith(".")) == [str(len(corpus_pipeline.STAGES) - 2)] for p in left)


def test_stages_of_nothing_and_of_messy_rows(spark, sf, messy, empty, monkeypatch):
    plain = messy.select("doc_id", "text", "lang", "source", "n_chars", "t", "rate")
    field = crf.train(load(spark, sf, "documents"), load(spark, sf, "labels"))
    monkeypatch.setattr(crf, "train", lambda *a: field)
    outs = []
    rows = plain
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, sf).persist()
        outs.append(sorted((r.doc_id or 0) for r in rows.collect()))
    rules, exact, near, mixed, packed = outs
    assert not {4, 5, 6, 11} & set(rules)  # null, empty and blank texts have no content
    texts = {r.doc_id or 0: r.text for r in plain.collect()}
    assert sorted({texts[i] for i in exact}) == sorted({r.text for r in plain.collect() if (r.doc_id or 0) in rules})
    assert set(near) <= set(exact) <= set(rules) and set(mixed) == set(near) == set(packed) and len(mixed) >= len(near)
    rows = empty.select(plain.columns)
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, sf)
        assert rows.count() == 0


def test_every_operator_has_a_query():
    names = {q.split("_")[0] for q in queries.QUERIES}
    assert names == {f"op{i}" for i in range(1, 11)}
    assert set(queries.ORACLES) <= set(queries.QUERIES)
    assert jaccard.GROUPS % jaccard.ROWS == 0
