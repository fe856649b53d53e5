"""Exact ranking metrics, thresholds and confusion counts.

All of them come from one table of counts by distinct score, made by a combinable
aggregation and cut from its lineage: the scored rows are read once, whatever is
asked. What needs the order of the scores uses running counts within ranges of
scores, so no task sees more than about a range's.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..lineage import cut

#: Distinct scores of a range.
RANGE = 250_000


@dataclass(frozen=True)
class Curve:
    """Counts by distinct score: threshold; p, n there; tp, fp at or above it; next_p, next_n at the next lower one; top, whether it is the highest."""

    points: DataFrame
    pos: int
    neg: int


def valid(rows: DataFrame, label: str, score: str) -> DataFrame:
    return rows.where(F.col(score).isNotNull() & ~F.isnan(score) & F.col(label).isin(0, 1))


def curve(rows: DataFrame | Curve, label: str = "label", score: str = "score", size: int = RANGE) -> Curve:
    """The counts of labelled rows; a Curve is returned as it is. Null and NaN scores and labels but 0 and 1 are left out.

    Up to size distinct scores are one range. More are cut at sampled bounds into
    ranges that are even whatever the scores' distribution; a range's first
    counts and sums are all that leaves it.
    """
    if isinstance(rows, Curve):
        return rows
    counts = cut(valid(rows, label, score).groupBy(F.col(score).cast("double").alias("threshold")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")))
    parts = max(1, -(-counts.count() // size))
    if parts > 1:
        counts = cut(counts.repartitionByRange(parts, F.col("threshold").desc()).withColumn("_b", F.spark_partition_id()))
    else:
        counts = counts.withColumn("_b", F.lit(0))
    heads = counts.groupBy("_b").agg(F.sum("p"), F.sum("n"), F.max_by(F.struct("p", "n"), "threshold")).orderBy("_b").collect()
    before, after, tp, fp = {}, {}, 0, 0
    for b, p, n, head in heads:
        before[b] = (tp, fp)
        tp, fp = tp + p, fp + n
    for (b, *_), (_, _, _, head) in zip(heads, heads[1:]):
        after[b] = (head["p"], head["n"])

    def entry(table: dict, i: int) -> Column:
        known = [x for b, v in table.items() for x in (F.lit(b), F.lit(v[i]).cast("long"))]
        return F.element_at(F.create_map(*known), F.col("_b")) if known else F.lit(None).cast("long")

    order = F.col("threshold").desc()
    w = Window.partitionBy("_b").orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    first = F.col("_b") == F.lit(heads[0][0] if heads else 0)
    points = counts.select(
        "threshold", "p", "n", (entry(before, 0) + F.sum("p").over(upto)).alias("tp"), (entry(before, 1) + F.sum("n").over(upto)).alias("fp"),
        F.coalesce(F.lead("p").over(w), entry(after, 0)).alias("next_p"), F.coalesce(F.lead("n").over(w), entry(after, 1)).alias("next_n"), (first & (F.row_number().over(w) == 1)).alias("top"),
    )
    return Curve(points, tp, fp)


def share(a: Column, total: int) -> Column:
    return a / F.lit(total) if total else F.lit(None).cast("double")


def rates(c: Curve, points: DataFrame) -> DataFrame:
    return points.select("threshold", "tp", "fp", share(F.col("tp"), c.pos).alias("tpr"), share(F.col("fp"), c.neg).alias("fpr"))


def roc(rows: DataFrame | Curve, label: str = "label", score: str = "score") -> DataFrame:
    """The whole curve: threshold, tpr, fpr (without the point of an infinite threshold)."""
    c = curve(rows, label, score)
    return rates(c, c.points)


def pruned_roc(rows: DataFrame | Curve, label: str = "label", score: str = "score") -> DataFrame:
    """roc() without inner points of straight stretches.

    A point goes if the counts at its score equal those at the next lower one, as
    then the curve goes on the same way; the first and last points stay.
    """
    c = curve(rows, label, score)
    return rates(c, c.points.where(F.col("top") | F.col("next_p").isNull() | (F.col("next_p") != F.col("p")) | (F.col("next_n") != F.col("n"))))


def ranking_metrics(rows: DataFrame | Curve, label: str = "label", score: str = "score") -> DataFrame:
    """One row: auroc (ties count half; null with one class only) and auprc (steps, no interpolation)."""
    c = curve(rows, label, score)
    wins = F.sum((F.col("n") * (F.col("tp") - F.col("p") / F.lit(2))).cast("double"))
    steps = F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp")))
    none = F.lit(None).cast("double")
    return c.points.agg((wins / F.lit(float(c.pos) * c.neg) if c.pos and c.neg else none).alias("auroc"), (steps / F.lit(c.pos) if c.pos else none).alias("auprc"))


def fpr_at_tpr(rows: DataFrame | Curve, target: float = 0.95, label: str = "label", score: str = "score") -> DataFrame:
    """One row: fpr at the first point of the pruned curve with tpr of at least target; 1 if there is none."""
    hit = pruned_roc(rows, label, score).where(F.col("tpr") >= target)
    return hit.agg(F.coalesce(F.max_by("fpr", "threshold"), F.lit(1.0)).alias("fpr_at_tpr"))


def choose_threshold(rows: DataFrame | Curve, target_tpr: float = 0.95, max_fpr: float | None = None, label: str = "label", score: str = "score") -> DataFrame:
    """One row: the threshold with the best tpr within max_fpr (lowest such, even if that tpr is 0).

    Infinite if only flagging nothing keeps to max_fpr. Without max_fpr, or if there
    is no negative to tell an fpr by, the least fpr that reaches target_tpr (highest
    such); 0.5 if nothing reaches it. Thresholds are those of the pruned curve.
    """
    c = curve(rows, label, score)
    points = pruned_roc(c)
    none = F.lit(float("inf"))
    if max_fpr is not None and max_fpr >= 0 and c.neg:
        ok = points.where(F.col("fpr") <= max_fpr)
        return ok.agg(F.coalesce(F.max_by("threshold", F.struct("tpr", -F.col("threshold"))), none).alias("threshold"))
    ok = points.where(F.col("tpr") >= target_tpr)
    if target_tpr <= 0 and c.pos:  # flagging nothing reaches that with no false positive
        return ok.agg(none.alias("threshold"))
    return ok.agg(F.coalesce(F.min_by("threshold", F.struct("fpr", -F.col("threshold"))), F.lit(0.5)).alias("threshold"))


def confusion_columns(p: Column, n: Column, hit: Column) -> list[Column]:
    """Counts and rates of rows that stand for p positives and n negatives each."""

    def total(x: Column, wanted: Column) -> Column:
        return F.coalesce(F.sum(F.when(wanted, x)), F.lit(0)).cast("long")

    tp, fp, tn, fn = total(p, hit), total(n, hit), total(n, ~hit), total(p, ~hit)

    def rate(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    rates_ = {"tpr": rate(tp, tp + fn), "fnr": rate(fn, tp + fn), "fpr": rate(fp, fp + tn), "tnr": rate(tn, fp + tn), "accuracy": rate(tp + tn, tp + tn + fp + fn)}
    return [c.alias(k) for k, c in {"tp": tp, "fp": fp, "tn": tn, "fn": fn, **rates_}.items()]


def confusion(rows: DataFrame | Curve, threshold: float | DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One row of counts and rates at a threshold, given as a number or as a one-row table; 0 where a rate has no rows."""
    points = curve(rows, label, score).points.select(F.col("threshold").alias("_s"), "p", "n")
    if isinstance(threshold, DataFrame):
        points = points.crossJoin(F.broadcast(threshold.select(F.col("threshold").alias("_t"))))
    else:
        points = points.withColumn("_t", F.lit(threshold))
    return points.agg(*confusion_columns(F.col("p"), F.col("n"), F.col("_s") >= F.col("_t")))


def group_diagnostics(rows: DataFrame, threshold: float, groups: Sequence[str] = ("source", "sample_type", "suite_name"), label: str = "label", score: str = "score") -> DataFrame:
    """Confusion by each value of each group column in one pass: dimension, value; null is "unknown"."""
    r = valid(rows, label, score)
    each = F.explode(F.array(*[F.struct(F.lit(g).alias("dimension"), F.coalesce(F.col(g).cast("string"), F.lit("unknown")).alias("value")) for g in groups]))
    long = r.select((F.col(label) == 1).cast("long").alias("_p"), (F.col(label) == 0).cast("long").alias("_n"), (F.col(score) >= F.lit(threshold)).alias("_hit"), each.alias("g"))
    return long.groupBy("g.dimension", "g.value").agg(*confusion_columns(F.col("_p"), F.col("_n"), F.col("_hit")))


def tradeoffs(rows: DataFrame | Curve, targets: Sequence[float], label: str = "label", score: str = "score") -> DataFrame:
    """For each target fpr the point within it of best tpr, then least fpr, then highest threshold; infinite if there is none.

    A rate without rows of its class is 0, as in confusion().
    """
    c = curve(rows, label, score)
    zero = F.lit(0.0)
    points = roc(c).withColumns({"tpr": F.coalesce("tpr", zero), "fpr": F.coalesce("fpr", zero)})
    wanted = F.explode(F.array(*[F.lit(float(t)) for t in targets])).alias("target_fpr")
    each = points.select("*", wanted).where(F.col("fpr") <= F.col("target_fpr"))
    best = each.groupBy("target_fpr").agg(F.max_by(F.struct("threshold", "tpr", "fpr"), F.struct("tpr", -F.col("fpr"), "threshold")).alias("b"))
    all_ = points.sparkSession.createDataFrame([(float(t),) for t in targets], "target_fpr double")
    return all_.join(F.broadcast(best), "target_fpr", "left").select("target_fpr", F.coalesce("b.threshold", F.lit(float("inf"))).alias("threshold"), F.coalesce("b.tpr", zero).alias("tpr"), F.coalesce("b.fpr", zero).alias("fpr"))


def tpr_map(points: DataFrame) -> DataFrame:
    """One row: a map tpr_at_fpr_%03d (percent) to tpr."""
    name = F.format_string("tpr_at_fpr_%03d", F.bround(F.col("target_fpr") * 100).cast("int"))
    return points.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name.alias("k"), F.col("tpr").alias("v"))))).alias("summary"))


def accuracy_column(c: Curve, threshold: float) -> Column:
    right = F.sum(F.when(F.col("threshold") >= threshold, F.col("p")).otherwise(F.col("n")))
    return share(right, c.pos + c.neg).alias("accuracy")


def accuracy(rows: DataFrame | Curve, threshold: float = 0.5, label: str = "label", score: str = "score") -> DataFrame:
    c = curve(rows, label, score)
    return c.points.agg(accuracy_column(c, threshold))


def bundle(rows: DataFrame | Curve, threshold: float = 0.5, label: str = "label", score: str = "score") -> DataFrame:
    """One row: auroc, auprc, accuracy, fpr at 95 % tpr."""
    c = curve(rows, label, score)
    out = ranking_metrics(c)
    for p in (accuracy(c, threshold), fpr_at_tpr(c, 0.95).withColumnRenamed("fpr_at_tpr", "fpr_at_95tpr")):
        out = out.crossJoin(F.broadcast(p))
    return out


def balanced_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """rows with the weight N / (classes * rows of the class)."""
    counts = rows.groupBy(F.col(label).alias("_l")).agg(F.count(F.lit(1)).alias("_n"))
    every = counts.agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_classes"))
    weights = counts.crossJoin(F.broadcast(every)).select("_l", (F.col("_all") / (F.col("_classes") * F.col("_n"))).alias("weight"))
    return rows.join(F.broadcast(weights), F.col(label) == F.col("_l")).drop("_l")


def training_mask(rows: DataFrame, label: str = "label") -> tuple[DataFrame, DataFrame]:
    """Rows whose label is not -1, and the numbers kept and dropped."""
    return rows.where(F.col(label) != -1), rows.agg(F.count_if(F.col(label) != -1).alias("kept"), F.count_if(F.col(label) == -1).alias("dropped"))
