"""Features of a step from its task, history and post tensors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import vectors as V


@dataclass(frozen=True)
class FeatureConfig:
    mode: str = "concat"
    use_anchors: bool = True
    self_baseline: bool = True


def drift(acts: DataFrame, mode: str = "concat") -> DataFrame:
    """acts with the changes (inc, glob, prog), their layer norms (hist_norm is that of prog, the history's way from the task), relative norms and cosines."""
    work = acts.withColumns({f"_{c}": V.layers(V.doubles(F.col(c)), mode) for c in ("task", "history", "post")})
    work = work.withColumns({"inc": V.subtract(F.col("_post"), F.col("_history")), "glob": V.subtract(F.col("_post"), F.col("_task")), "prog": V.subtract(F.col("_history"), F.col("_task"))})
    work = work.withColumns({"inc_norm": V.norms(F.col("inc")), "glob_norm": V.norms(F.col("glob")), "hist_norm": V.norms(F.col("prog"))})
    work = work.withColumns({"rel_norm": V.relative(F.col("inc_norm"), F.col("hist_norm")), "cosine": V.cosines(F.col("inc"), F.col("glob"))})
    return work.drop("_task", "_history", "_post")


def anchors(rows: DataFrame, vector: Column, n: int, order: Column) -> list[list[float]]:
    """The vectors of the n benign rows (label 0) that come first by a hash; n is a parameter, so they fit the driver."""
    picked = rows.where("label = 0").select(order.alias("_o"), vector.alias("_v")).orderBy("_o").limit(n).collect()
    if not picked:
        raise ValueError("there is no benign row to take anchors from")
    return [list(r["_v"]) for r in picked]


def anchor_table(rows: DataFrame, vector: Column, n: int, order: Column) -> DataFrame:
    """One row with all anchors, for a broadcast; as anchors(), but without passing the driver."""
    picked = rows.where("label = 0").select(order.alias("_o"), vector.alias("_v")).orderBy("_o").limit(n)
    return picked.agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_v"))), lambda s: s["_v"]).alias("anchors"))


def anchor_distances(rows: DataFrame, vector: Column, table: DataFrame, out: str = "anchor_stats") -> DataFrame:
    """rows with mean, least, largest and deviation of the distances to all anchors; no shuffle of rows."""
    return rows.crossJoin(F.broadcast(table)).withColumn(out, V.distance_stats(vector, F.col("anchors"))).drop("anchors")


def anchor_mean(table: DataFrame) -> DataFrame:
    """One row with the mean anchor."""
    zero = F.transform(F.get("anchors", F.lit(0)), lambda v: F.lit(0.0))
    total = F.aggregate("anchors", zero, lambda s, a: F.zip_with(s, a, lambda p, q: p + q))
    return table.select(F.transform(total, lambda v: v / F.size("anchors")).alias("center"))


def anchor_differences(rows: DataFrame, vector: Column, table: DataFrame, out: str = "anchor_diff") -> DataFrame:
    """rows with their vector less the mean anchor."""
    return rows.crossJoin(F.broadcast(anchor_mean(table))).withColumn(out, F.zip_with(vector, "center", lambda a, b: a - b)).drop("center")


def minimal_norms(rows: DataFrame) -> DataFrame:
    """rows with the means over layers of the incremental and global norms."""
    return rows.withColumns({"inc_mean": V.mean(F.col("inc_norm")), "glob_mean": V.mean(F.col("glob_norm"))})


def benign_baseline(rows: DataFrame, norms: tuple[str, ...] = ("inc_norm", "glob_norm", "hist_norm", "rel_norm")) -> DataFrame:
    """Mean and population deviation of each norm and layer over benign rows; empty with fewer than two."""
    long = rows.where("label = 0").select(F.explode(F.array(*[F.struct(F.lit(n).alias("norm"), F.col(n).alias("v")) for n in norms])).alias("s"))
    each = long.select("s.norm", F.posexplode("s.v").alias("layer", "v"))
    return each.groupBy("norm", "layer").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("deviation"), F.count(F.lit(1)).alias("n")).where("n >= 2").drop("n")


def self_baseline(rows: DataFrame, norm: str, layers: int, key: str = "sample_index", order: str = "step_index", baseline: dict[int, tuple[float, float]] | None = None) -> DataFrame:
    """rows with z-scores of a norm's layers against the strictly earlier steps of the trajectory.

    With fewer than two earlier steps the benign baseline (layer: mean, deviation)
    stands in, and 0 without one. One window a call: moments of all layers share its sort.
    """
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out, n = [], F.count(F.lit(1)).over(w)
    for k in range(layers):
        x = F.get(norm, F.lit(k))
        prior = (x - F.avg(x).over(w)) / (F.stddev_pop(x).over(w) + F.lit(V.EPSILON))
        other = F.lit(0.0)
        if baseline and k in baseline:
            mean, deviation = baseline[k]
            other = (x - F.lit(mean)) / F.lit(deviation + V.EPSILON)
        out.append(F.when(n >= 2, prior).otherwise(other))
    return rows.withColumn(f"{norm}_z", F.array(*out))


NORMS = ("inc_norm", "glob_norm", "hist_norm", "rel_norm")

#: Layer statistics of benign rows: norm, then layer, then (mean, deviation).
Baseline = dict[str, dict[int, tuple[float, float]]]


def collected_baseline(rows: DataFrame) -> Baseline:
    """benign_baseline() in the driver: four norms of each layer."""
    out: Baseline = {}
    for r in benign_baseline(rows).collect():
        out.setdefault(r["norm"], {})[r["layer"]] = (r["mean"], r["deviation"])
    return out


def with_anchors(rows: DataFrame, anchored: dict[str, list[list[float]]]) -> DataFrame:
    """rows of drift() with the distance statistics to the anchors of changes (inc, glob); works on streams too."""
    for name in ("inc", "glob"):
        table = rows.sparkSession.createDataFrame([(anchored[name],)], "anchors array<array<double>>")
        rows = anchor_distances(rows, F.flatten(name), table, f"{name}_anchor_stats")
    return rows


def featurize(acts: DataFrame, cfg: FeatureConfig, layers: int, anchored: dict[str, list[list[float]]] | None = None, baseline: Baseline | None = None, out: str = "features") -> DataFrame:
    """Steps' triples of tensors with the whole feature vector; layers is how many drift() leaves."""
    rows = drift(acts, cfg.mode)
    if cfg.use_anchors:
        if anchored is None:
            raise ValueError("distances to anchors need both sets of anchors")
        rows = with_anchors(rows, anchored)
    if cfg.self_baseline:
        for n in NORMS:
            rows = self_baseline(rows, n, layers, baseline=(baseline or {}).get(n))
    return assemble(rows, cfg, out)


def assemble(rows: DataFrame, cfg: FeatureConfig, out: str = "features") -> DataFrame:
    """rows of drift() with one array in fixed order: changes, norms, cosines, then anchor statistics and z-scores if configured."""
    parts = [F.flatten("inc"), F.flatten("glob"), *map(F.col, ("inc_norm", "glob_norm", "hist_norm", "rel_norm", "cosine"))]
    if cfg.use_anchors:
        parts += [F.col("inc_anchor_stats"), F.col("glob_anchor_stats")]
    if cfg.self_baseline:
        parts += [F.col(f"{n}_z") for n in ("inc_norm", "glob_norm", "hist_norm", "rel_norm")]
    return rows.withColumn(out, F.concat(*parts))
