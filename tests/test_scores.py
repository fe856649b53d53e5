import math

import pytest
from pyspark.sql import functions as F

from driftspark.operators import aggregate as A, metrics as M, traces as R


def one(spark, scores, spec):
    return spark.createDataFrame([(scores,)], "s array<double>").select(A.aggregate_scores(F.col("s"), spec).alias("v")).first().v


@pytest.mark.parametrize(
    "scores,spec,want",
    [
        ([], "max", 0), ([], "cusum", 0), ([], "mean", 0), ([], "top2_mean", 0), ([], "first_exceed_2", 0), ([0.1, 0.8, 0.4], "max", 0.8), ([0.1, 0.8, 0.4], "top2_mean", 0.6), ([0.3], "top_2_mean", 0.3), ([0.1, 0.3], "mean", 0.2),
        ([0.1, 0.9, 0.2, 0.1, 0.1], "first_exceed_3", 0.9), ([0.2, 0.2, 0.3, 0.1, 0.95], "first_exceed_3", 0.3), ([0.2, 0.3, 0.85, 0.2, 0.3], "cusum", 0.35), ([0.6, 0.6, 0.7, 0.8, 0.9], "cusum", 1.1),
        ([0.7, 0.7, 0.2, 0.2, 0.2], "cusum_w2", 0.4), ([0.7, 0.7, 0.9], "cusum_2", 0.4), ([0.7, 0.7], "cusum_s0.1_r0.4_junk", 0.4),
    ],
)
def test_aggregations(spark, scores, spec, want):
    assert one(spark, scores, spec) == pytest.approx(want)


@pytest.mark.parametrize("spec", ["median", "first_exceed_0", "first_exceed_x", "first_exceed_-1", ""])
def test_unknown_aggregations(spec):
    with pytest.raises(ValueError):
        A.parse_strategy(spec)


def steps(spark, rows):
    return spark.createDataFrame(rows, "sample_index long, step_index int, score double, trajectory_label int")


def test_trajectories_follow_step_order(spark):
    df = steps(spark, [(20, 1, 0.8, 1), (10, 0, 0.1, 0), (20, 0, 0.4, 1), (10, 1, 0.7, 0)])
    assert {r.sample_index: r.score for r in A.trajectories(df, "top2_mean").collect()} == pytest.approx({10: 0.4, 20: 0.6})
    assert {r.sample_index: (r.label, r.n_steps) for r in A.trajectories(df, "max").collect()} == {10: (0, 2), 20: (1, 2)}


def test_labels_must_agree(spark):
    with pytest.raises(Exception, match="different labels"):
        A.trajectories(steps(spark, [(1, 0, 0.1, 0), (1, 1, 0.1, 1)]), "max").collect()


@pytest.mark.parametrize("spec", ["max", "mean", "top2_mean", "first_exceed_2", "cusum", "cusum_w3_s0.05_r0.4"])
def test_running_scores_are_aggregations_of_prefixes(spark, spec):
    values = [0.3, 0.9, 0.1, 0.8, 0.75, 0.2, 0.95]
    got = A.running_scores(steps(spark, [(1, i, v, 0) for i, v in enumerate(values)]), spec).orderBy("step_index").collect()
    assert [r.running for r in got] == pytest.approx([one(spark, values[: i + 1], spec) for i in range(len(values))])


def test_alerts(spark):
    got = A.first_alerts(steps(spark, [(1, i, v, 0) for i, v in enumerate([0.9, 0.1, 0.1])] + [(2, 0, 0.1, 0)]), "mean", 0.5)
    assert {r.sample_index: (r.first_step, r.last_step, r.triggered, r.triggered_at_end) for r in got.collect()} == {1: (0, 1, True, False), 2: (None, None, False, False)}


def scored(spark, labels, scores):
    return spark.createDataFrame(list(zip(labels, scores)), "label int, score double")


def test_perfect_ranking(spark):
    r = M.bundle(scored(spark, [0, 0, 1, 1], [0.1, 0.2, 0.8, 0.9])).first()
    assert (r.auroc, r.auprc, r.accuracy, r.fpr_at_95tpr) == (1, 1, 1, 0)


def test_confusion_and_tradeoffs(spark):
    df = scored(spark, [0, 0, 1, 1], [0.1, 0.7, 0.6, 0.9])
    r = M.confusion(df, 0.65).first()
    assert (r.tp, r.fp, r.fn, r.tn, r.fpr) == (1, 1, 1, 1, 0.5)
    t = M.tradeoffs(df, [0.0, 0.5]).orderBy("target_fpr").collect()
    assert [(x.threshold, x.tpr, x.fpr) for x in t] == [(0.9, 0.5, 0), (0.6, 1, 0.5)]
    assert M.tpr_map(M.tradeoffs(df, [0.0, 0.5])).first().summary == {"tpr_at_fpr_000": 0.5, "tpr_at_fpr_050": 1.0}
    nothing = M.tradeoffs(scored(spark, [0, 1], [0.9, 0.1]), [0.0]).first()
    assert math.isinf(nothing.threshold)


def test_one_class_has_no_auroc(spark):
    r = M.ranking_metrics(scored(spark, [1, 1], [0.1, 0.2])).first()
    assert r.auroc is None and r.auprc == 1
    assert M.ranking_metrics(scored(spark, [], [])).first().auroc is None


def test_nan_scores_are_left_out(spark):
    df = scored(spark, [0, 1, 1], [0.1, 0.9, float("nan")])
    assert M.ranking_metrics(df).first().auroc == 1


def brute_curve(labels, scores):
    """All points by descending threshold, without inner points of straight stretches."""
    ts = sorted(set(scores), reverse=True)
    pts = [(t, sum(1 for y, s in zip(labels, scores) if s >= t and y == 1), sum(1 for y, s in zip(labels, scores) if s >= t and y == 0)) for t in ts]
    keep = [i for i in range(len(pts)) if i in (0, len(pts) - 1) or (pts[i][1] - pts[i - 1][1], pts[i][2] - pts[i - 1][2]) != (pts[i + 1][1] - pts[i][1], pts[i + 1][2] - pts[i][2])]
    return [pts[i] for i in keep]


@pytest.mark.parametrize("seed", range(3))
def test_pruned_curve_agrees_with_second_differences(spark, seed):
    import random

    rng = random.Random(seed)
    scores = [round(rng.random(), 2) for _ in range(120)]
    labels = [int(rng.random() < s) for s in scores]
    df = scored(spark, labels, scores)
    got = [(r.threshold, r.tp, r.fp) for r in M.pruned_roc(df).orderBy(F.col("threshold").desc()).collect()]
    assert got == brute_curve(labels, scores)
    n, p = labels.count(0), labels.count(1)
    pairs = sum((a > b) + (a == b) / 2 for a, y in zip(scores, labels) for b, z in zip(scores, labels) if y == 1 and z == 0)
    assert M.ranking_metrics(df).first().auroc == pytest.approx(pairs / n / p)
    ok = [(t, tp / p, fp / n) for t, tp, fp in got]
    reach = [x for x in ok if x[1] >= 0.8]
    assert M.choose_threshold(df, 0.8).first().threshold == min(reach, key=lambda x: (x[2], -x[0]))[0]
    for most in (0.0, 0.02, 0.3):
        within = [(math.inf, 0.0, 0.0)] + [x for x in ok if x[2] <= most]
        assert M.choose_threshold(df, max_fpr=most).first().threshold == max(within, key=lambda x: (x[1], -x[0]))[0]
    for size in (7, 40):  # several ranges
        c = M.curve(df, size=size)
        assert [(r.threshold, r.tp, r.fp) for r in M.pruned_roc(c).orderBy(F.col("threshold").desc()).collect()] == got
        assert M.bundle(c).first() == M.bundle(df).first() and M.confusion(c, 0.4).first() == M.confusion(df, 0.4).first()


def test_thresholds_keep_to_an_fpr_even_without_a_hit(spark):
    negatives_first = scored(spark, [0, 1, 0, 0, 0, 0, 0, 0, 1], [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1])
    assert M.choose_threshold(negatives_first, max_fpr=0.15).first().threshold == 0.8
    top = scored(spark, [0, 0, 1] + [0] * 6, [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1])
    assert M.choose_threshold(top, max_fpr=0.13).first().threshold == 0.9
    assert math.isinf(M.choose_threshold(top, max_fpr=0.1).first().threshold)
    assert M.choose_threshold(scored(spark, [1, 1], [0.2, 0.6]), max_fpr=0.1).first().threshold == 0.2
    assert M.choose_threshold(scored(spark, [0, 0], [0.2, 0.6]), 0.9).first().threshold == 0.5
    assert math.isinf(M.choose_threshold(top, 0.0).first().threshold)
    empty = scored(spark, [], [])
    assert M.choose_threshold(empty).first().threshold == 0.5 and M.bundle(empty).first().fpr_at_95tpr == 1 and M.confusion(empty, 0.5).first().tp == 0


def test_saturated_scores_are_spread(spark):
    """Scores that differ in the tenth digit only do not end in one range."""
    df = spark.range(4000).select((F.col("id") % 2).cast("int").alias("label"), (1 - F.col("id") * 1e-10).alias("score"))
    points = M.curve(df, size=500).points
    assert points.select(F.max("tp"), F.max("fp"), F.count(F.lit(1))).first() == (2000, 2000, 4000)
    assert points.where("tp + fp = 1").first().threshold == 1.0 and points.where("top").count() == 1 and points.where("next_p is null").count() == 1


def test_groups(spark):
    df = spark.createDataFrame([(0, 0.2, "a", None), (1, 0.9, "b", "s2")], "label int, score double, source string, suite_name string")
    got = {(r.dimension, r.value): r for r in M.group_diagnostics(df, 0.75, ("source", "suite_name")).collect()}
    assert got["source", "a"].tn == 1 and got["source", "b"].tp == 1 and got["suite_name", "s2"].tpr == 1 and ("suite_name", "unknown") in got


def test_weights_and_mask(spark):
    df = scored(spark, [0, 0, 0, 1, -1], [0.0] * 5)
    kept, counts = M.training_mask(df)
    assert tuple(counts.first()) == (4, 1)
    assert {r.label: round(r.weight, 4) for r in M.balanced_weights(kept).collect()} == {0: 0.6667, 1: 2.0}


TRACE = "suite_name string, user_task_id string, injection_task_id string, attack_type string, error string, utility boolean, security boolean, triggered boolean, aborted boolean, trigger_step int, scores array<double>"


def test_trace_summary(spark):
    rows = [
        ("s", "user_task_0", None, None, None, True, None, False, False, None, [0.1]), ("s", "user_task_1", None, "none", "stop: task drift", False, None, None, None, None, None),
        ("t", "user_task_0", "i", "x", None, True, True, True, True, 2, [0.9]), (None, "user_task_1", "i", "x", None, False, False, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, TRACE)
    r = R.summarize(df).first()
    assert (r["count"], r.clean_count, r.attacked_count, r.utility_clean, r.security_attacked, r.attack_success_rate) == (4, 2, 2, 0.5, 0.5, 0.5)
    assert (r.trigger_rate_attacked, r.benign_false_abort_rate, r.mean_trigger_step, r.detector_evaluated_count) == (1.0, 0.5, 2.0, 2)
    by = {(x.level, x.value): x["count"] for x in R.summarize_levels(df).collect()}
    assert by["overall", ""] == 4 and by["suite", "unknown"] == 1 and by["attack", "none"] == 2 and by["suite_attack", "t/x"] == 1 and by["user_task", "s/user_task_1"] == 1
    assert R.step_scores(df).count() == 2
    empty = R.summarize(df.where("false")).first()
    assert empty["count"] == 0 and empty.utility_clean is None


def test_injection_tasks_are_not_regular(spark):
    row = ("s", "injection_task_1", None, None, None, True, None, True, None, None, None)
    r = R.summarize(spark.createDataFrame([row, ("s", "user_task_1", *row[2:])], TRACE)).first()
    assert (r.clean_count, r.regular_clean_count) == (2, 1)
