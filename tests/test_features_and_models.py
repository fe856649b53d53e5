import numpy as np
import pytest
from pyspark.sql import functions as F

from driftspark.functions import vectors as V
from driftspark.operators import detectors as D, encode as E, features as X, steps as S

ACT = "sample_index long, step_index int, task array<array<float>>, history array<array<float>>, post array<array<float>>, label int, trajectory_label int, source string, sample_type string, suite_name string"


def synthetic(spark, n=24, steps=4, layers=2, hidden=4, seed=0, shift=0.0):
    """Benign steps move a little, malicious ones by 2.5; all is shifted."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        bad = i % 2
        for k in range(steps):
            hist = 0.05 * rng.normal(size=(layers, hidden))
            hit = int(bad and k >= 2)
            post = hist + 2.5 * hit + 0.05 * rng.normal(size=(layers, hidden))
            rows.append((i, k, np.full((layers, hidden), shift).tolist(), (hist + shift).tolist(), (post + shift).tolist(), hit, bad, f"s{i % 3}", "t", None))
    return spark.createDataFrame(rows, ACT)


def arrays(df, *columns):
    rows = df.orderBy("sample_index", "step_index").select(*columns).collect()
    return [np.array([r[c] for r in rows], float) for c in columns]


@pytest.mark.parametrize("shift", [0.0, 3.0])
def test_drift_agrees_with_numpy(spark, shift):
    acts = synthetic(spark, shift=shift)
    task, hist, post = arrays(acts, "task", "history", "post")
    df = X.drift(acts)
    inc, glob, prog = arrays(df, "inc", "glob", "prog")
    assert np.allclose(inc, post - hist) and np.allclose(glob, post - task) and np.allclose(prog, hist - task)
    a, b, h, r, c = arrays(df, "inc_norm", "glob_norm", "hist_norm", "rel_norm", "cosine")
    n = np.linalg.norm
    assert np.allclose(a, n(inc, axis=2)) and np.allclose(b, n(glob, axis=2)) and np.allclose(h, n(hist - task, axis=2)) and np.allclose(r, a / (h + 1e-6))
    assert np.allclose(c, (inc * glob).sum(2) / (a * b))


def test_zero_vectors_have_no_direction(spark):
    df = spark.createDataFrame([([[0.0, 0.0]], [[1.0, 0.0]])], "a array<array<double>>, b array<array<double>>")
    assert df.select(V.cosines(F.col("a"), F.col("b")).alias("c")).first().c == [0.0]


@pytest.mark.parametrize("mode,baseline,width", [("concat", False, 26), ("last_only", False, 13), ("concat", True, 34)])
def test_feature_widths(spark, mode, baseline, width):
    df = X.drift(synthetic(spark, 4), mode)
    if baseline:
        for n in ("inc_norm", "glob_norm", "hist_norm", "rel_norm"):
            df = X.self_baseline(df, n, 2)
    out = X.assemble(df, X.FeatureConfig(mode, use_anchors=False, self_baseline=baseline))
    assert {len(r.features) for r in out.collect()} == {width}
    with pytest.raises(ValueError):
        V.layers(F.col("post"), "first")


def test_layers_are_picked_after_the_embedding(spark):
    df = spark.createDataFrame([([[0.0], [1.0], [2.0], [3.0]], [[[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]]])], "s array<array<double>>, t array<array<array<double>>>")
    r = df.select(V.pick(F.col("s"), [0, 2]).alias("p"), V.mean_pool(F.col("t"), 2).alias("m"), V.mean_pool(F.col("t"), 9).alias("all")).first()
    assert r.p == [[1.0], [3.0]] and r.m == [[4.0, 5.0]] and r.all == [[3.0, 4.0]]
    with pytest.raises(Exception):
        df.select(V.pick(F.col("s"), [7])).collect()


def test_anchors(spark):
    acts = synthetic(spark)
    flat = F.flatten(V.doubles(F.col("post")))
    order = F.sha1(F.concat_ws("|", "sample_index", "step_index"))
    points = np.array(X.anchors(acts, flat, 5, order))
    table = X.anchor_table(acts, flat, 5, order)
    assert points.shape == (5, 8) and np.allclose(points, table.first().anchors) and np.abs(points).max() < 1
    got = arrays(X.anchor_distances(acts, flat, table), "anchor_stats")[0]
    post = arrays(acts, "post")[0].reshape(-1, 8)
    d = np.linalg.norm(post[:, None] - points[None], axis=2)
    assert np.allclose(got, np.stack([d.mean(1), d.min(1), d.max(1), d.std(1, ddof=1)], 1))
    assert np.allclose(arrays(X.anchor_differences(acts, flat, table), "anchor_diff")[0], post - points.mean(0))
    lone = X.anchor_distances(acts, flat, X.anchor_table(acts, flat, 1, order)).first().anchor_stats
    assert lone[3] is None
    with pytest.raises(ValueError):
        X.anchors(acts.where("label = 1"), flat, 2, order)


def test_baselines_look_back_only(spark):
    df = X.drift(synthetic(spark, 3, steps=4))
    z = X.self_baseline(df, "inc_norm", 2)
    norm, got = arrays(z, "inc_norm", "inc_norm_z")
    norm, got = norm.reshape(3, 4, 2), got.reshape(3, 4, 2)
    assert (got[:, :2] == 0).all()
    for k in (2, 3):
        want = (norm[:, k] - norm[:, :k].mean(1)) / (norm[:, :k].std(1) + 1e-6)
        assert np.allclose(got[:, k], want, rtol=1e-6)
    base = {r.layer: (r["mean"], r.deviation) for r in X.benign_baseline(df).where("norm = 'inc_norm'").collect()}
    first = arrays(X.self_baseline(df, "inc_norm", 2, baseline=base), "inc_norm_z")[0].reshape(3, 4, 2)[:, 0]
    assert np.allclose(first, [[(norm[i, 0, k] - base[k][0]) / (base[k][1] + 1e-6) for k in range(2)] for i in range(3)])
    assert X.benign_baseline(df.where("label = 0").limit(1)).count() == 0


@pytest.mark.parametrize("kind,params", [("gbt", {"iterations": 5}), ("logistic", {}), ("forest", {"trees": 10}), ("scaled_logistic", {})])
def test_detectors_find_clusters(spark, tmp_path, kind, params):
    df = X.minimal_norms(X.drift(synthetic(spark))).withColumn("features", F.concat(F.array("inc_mean", "glob_mean"), "inc_norm")).persist()
    extra = df.limit(1).withColumn("label", F.lit(-1))
    detector = D.calibrate(D.fit(df.unionByName(extra), kind, **params), df)
    out = D.evaluate(detector, df, ("source",))
    assert out["metrics"].first().auroc > 0.95 and out["groups"].count() == 3 and out["tradeoffs"].count() == 4
    detector.save(spark, str(tmp_path / kind))
    again = D.Detector.load(spark, str(tmp_path / kind))
    assert again.threshold == detector.threshold and again.metrics == detector.metrics
    assert [r.score for r in again.score(df).orderBy("sample_index", "step_index").collect()] == pytest.approx([r.score for r in detector.score(df).orderBy("sample_index", "step_index").collect()])
    with pytest.raises(ValueError):
        D.estimator("svm")


def test_detectors_of_another_version_are_refused(spark, tmp_path):
    spark.createDataFrame([('{"version": 0}',)], "value string").write.text(str(tmp_path / "detector.json"))
    with pytest.raises(ValueError):
        D.Detector.load(spark, str(tmp_path))


def test_each_prefix_is_encoded_once(spark, tmp_path):
    log = str(tmp_path / "calls")
    turns = [("system", "S"), ("user", "U"), ("tool", "A"), ("tool", "B")]
    df = spark.createDataFrame([(0, 0, [{"role": r, "content": c} for r, c in turns], None, None, None)], "sample_index long, label int, messages array<struct<role:string,content:string>>, malicious_idx array<int>, injection_fragments array<string>, injection_text string")

    class Counting(E.HashEncoder):
        def __call__(self, prefixes, tasks):
            with open(log, "a") as f:
                f.write("x\n" * len(prefixes))
            return super().__call__(prefixes, tasks)

    rows = E.activations(S.tool_steps(df), Counting).orderBy("step_index").collect()
    with open(log) as f:
        assert len(f.readlines()) == 4  # task, two histories (one is a post state), last post
    assert rows[0].post == rows[1].history and rows[0].task == rows[1].task and len(rows[0].task) == 4
    plain = E.HashEncoder()([[{"role": "system", "content": "S"}]], ["U"])[0]
    assert np.allclose(rows[0].task, plain, atol=1e-6)


def test_drift_detector_featurises_new_steps(spark, tmp_path):
    """The whole vector, with anchors and baseline, from a saved and loaded detector; and its numbers outside Spark."""
    from driftspark.operators.portable import Portable, exported

    acts = synthetic(spark, shift=1.0)
    detector = D.fit_drift(acts, n_anchors=6, iterations=5)
    rows = detector.features(acts)
    assert {len(r.features) for r in rows.select("features").collect()} == {2 * 2 * 4 + 5 * 2 + 8 + 4 * 2}
    D.calibrate(detector, rows)
    assert detector.metrics["val"]["auroc"] > 0.95
    detector.save(spark, str(tmp_path / "d"))
    again = D.Detector.load(spark, str(tmp_path / "d"))
    assert (again.config, again.layers, again.baseline) == (detector.config, 2, detector.baseline) and again.anchors == detector.anchors
    new = synthetic(spark, 6, seed=5, shift=1.0)
    want = [r.score for r in detector.score(detector.features(new)).orderBy("sample_index", "step_index").collect()]
    scored = again.score(again.features(new)).orderBy("sample_index", "step_index").collect()
    assert [r.score for r in scored] == pytest.approx(want)
    x = np.array([r.features for r in scored])
    assert Portable(exported(spark, again.model)).score(x) == pytest.approx(np.array(want), abs=1e-9)
    with pytest.raises(ValueError):
        D.fit(rows, "logistic").features(new)


@pytest.mark.parametrize("kind,params", [("logistic", {}), ("forest", {"trees": 7}), ("scaled_logistic", {})])
def test_exported_models_agree_with_spark(spark, kind, params):
    from driftspark.operators.portable import Portable, exported

    df = X.minimal_norms(X.drift(synthetic(spark))).withColumn("features", F.concat(F.array("inc_mean", "glob_mean"), "inc_norm"))
    detector = D.fit(df, kind, **params)
    rows = detector.score(df).select("features", "score").collect()
    assert Portable(exported(spark, detector.model)).score(np.array([r.features for r in rows])) == pytest.approx(np.array([r.score for r in rows]), abs=1e-9)
