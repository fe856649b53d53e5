import pytest
from pyspark.sql import functions as F

from driftspark.operators import clean, splits as P
from driftspark.operators.ranking import hash_rank

COLS = "ord long, label int, text string, source string, split_group string"


def table(spark, rows):
    return clean.with_id(spark.createDataFrame(rows, COLS))


def test_ranks_agree_with_plain_windows(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), F.sha1(F.col("id").cast("string")).alias("h"))
    got = hash_rank(df, ["g"], F.col("h")).selectExpr("rank", "size", "row_number() over (partition by g order by h) r", "count(*) over (partition by g) n")
    assert got.where("rank <> r or size <> n").count() == 0


def test_null_strata_are_ranked(spark):
    df = spark.createDataFrame([(None, "a"), (None, "b"), ("x", "c")], "g string, h string")
    assert sorted(r["rank"] for r in hash_rank(df, ["g"], F.sha1("h")).collect()) == [1, 1, 2]


def test_dedup_keeps_the_first(spark):
    rows = table(spark, [(0, 1, "t", "s", None), (1, 1, "t", "s", None), (2, 0, "t", "s", None)])
    assert sorted(r.ord for r in clean.first_of_each(rows).collect()) == [0, 2]


def test_grouped_split_is_stratified_and_atomic(spark):
    rows = [(i, i % 2, f"p{i}", "s", f"pair{i // 2}") for i in range(20)] + [(100 + i, 0, f"c{i}", "s", None) for i in range(10)]
    got = P.grouped(table(spark, rows), 0.5).collect()
    for side in ("left", "right"):
        part = [r for r in got if r.side == side]
        assert len({r.split_group for r in part if r.split_group}) == 5 and sum(r.split_group is None for r in part) == 5
    left, right = ({r.split_group for r in got if r.side == s and r.split_group} for s in ("left", "right"))
    assert not left & right


def test_three_way_split_has_no_leaks(spark):
    rows = [(i, i % 2, f"a{i}", "agents", f"g{i // 2}") for i in range(20)] + [(100 + i, i % 2, f"o{i}", "other", None) for i in range(20)]
    out = P.make_splits(table(spark, rows), "agents", 0.7)
    assert out.count() == 40 and P.leaks(out).count() == 0
    by = {(r.source, r.split) for r in out.collect()}
    assert by == {("agents", "train"), ("agents", "val"), ("agents", "test"), ("other", "train"), ("other", "val")}
    assert P.missing_labels(out.where("split = 'train'").where("label = 0")).collect()[0].missing == 1


@pytest.mark.parametrize("groups,want", [(1, {"train": 1}), (2, {"train": 1, "test": 1}), (10, {"train": 6, "val": 2, "test": 2})])
def test_few_groups(spark, groups, want):
    rows = table(spark, [(i, 0, f"t{i}", "s", f"g{i}") for i in range(groups)])
    got = {r.split: r["count"] for r in P.three_way(rows).groupBy("split").count().collect()}
    assert got == want


def test_lone_rows_go_left(spark):
    got = P.stratified(table(spark, [(0, 0, "a", "x", None), (1, 0, "b", "y", None), (2, 0, "c", "y", None)]), 0.1).collect()
    assert {r.ord: r.side for r in got}[0] == "left" and sorted(r.side for r in got if r.ord) == ["left", "right"]


def test_balanced_cap(spark):
    rows = table(spark, [(i, int(i >= 3), f"t{i}", "s", None) for i in range(20)])
    got = [r.label for r in clean.balanced_cap(rows, 10, F.col("sample_id")).collect()]
    assert len(got) == 10 and got.count(0) == 3 and got[:3] == [0, 0, 0]
    assert clean.balanced_cap(rows, 100, F.col("sample_id")).count() == 20


def test_locators(spark):
    rows = spark.createDataFrame([(1, "a", [3], None, None), (1, "a", [], [], ""), (1, "b", None, ["f"], None), (1, "b", None, None, "t"), (0, "c", None, None, None)], "label int, source string, i array<int>, f array<string>, t string")
    kept, dropped = clean.drop_unlocatable(rows, clean.has_locator(F.col("i"), F.col("f"), F.col("t")))
    assert kept.count() == 4 and [tuple(r) for r in dropped.collect()] == [("a", 1)]


def test_mini_subset_keeps_pairs_whole(spark):
    rows = [(i, i % 2, f"t{i}", "s", f"cf:{i // 2}") for i in range(40)] + [(100 + i, 0, f"n{i}", "s", "user:x") for i in range(10)]
    df = table(spark, rows).withColumn("mini_key", P.mini_group(F.lit(None).cast("string"), F.col("split_group"), F.col("ord")))
    got = P.mini_subset(df, 0.2, 1.0, 42).collect()
    pairs = [r.split_group for r in got if r.split_group.startswith("cf:")]
    assert len(pairs) == 2 * len(set(pairs)) == 24 and sum(r.split_group == "user:x" for r in got) == 10


def test_remap_is_dense(spark):
    steps = spark.createDataFrame([(k, s) for k in (5, 9, 200_000) for s in range(2)], "sample_index long, step_index int")
    got = {(r.original_index, r.sample_index) for r in P.remap(steps, steps.where("sample_index <> 9")).collect()}
    assert got == {(5, 0), (200_000, 1)}


def test_distribution_report(spark):
    before = table(spark, [(0, 0, "a", "s", None), (1, 0, "b", "s", None)])
    after = table(spark, [(0, 0, "a", "s", None), (2, 1, "c", "s", None)])
    got = {r.label: (r.n_before, r.n_after, r.ratio) for r in clean.before_after(before, after).collect()}
    assert got == {0: (2, 1, 0.5), 1: (0, 1, None)}
