"""From step scores to one score a trajectory."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F


@dataclass(frozen=True)
class Strategy:
    name: str
    first: int | None = None
    slack: float = 0.0
    reference: float = 0.5


def parse_strategy(spec: str) -> Strategy:
    """max, mean, top2_mean (or top-2 mean), first_exceed_K, cusum with optional _wN (or _N), _sX, _rY."""
    s = spec.strip().lower()
    if s in ("max", "mean"):
        return Strategy(s)
    if re.sub(r"[-_ ]", "", s) == "top2mean":
        return Strategy("top2_mean")
    if s.startswith("first_exceed_"):
        k = s.removeprefix("first_exceed_")
        if not re.fullmatch(r"[+-]?\d+", k) or int(k) <= 0:
            raise ValueError(f"{spec!r} needs a positive whole number")
        return Strategy("first_exceed", int(k))
    if s == "cusum" or s.startswith("cusum_"):
        found: dict[str, float] = {}
        for token in s.split("_")[1:]:
            m = re.fullmatch(r"([wsr]?)(-?\d+(?:\.\d+)?)", token)
            if m:
                found[m[1] or "w"] = float(m[2])
        first = max(1, int(found["w"])) if "w" in found else None
        return Strategy("cusum", first, found.get("s", 0.0), found.get("r", 0.5))
    raise ValueError(f"unknown aggregation {spec!r}")


def aggregate_scores(scores: Column, strategy: Strategy | str) -> Column:
    """One score of an ordered array; 0 for an empty one."""
    st = parse_strategy(strategy) if isinstance(strategy, str) else strategy
    if st.name == "max":
        value = F.array_max(scores)
    elif st.name == "mean":
        value = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(scores), F.lit(0))
    elif st.name == "top2_mean":
        top = F.slice(F.sort_array(scores, asc=False), 1, 2)
        value = F.aggregate(top, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(top), F.lit(0))
    elif st.name == "first_exceed":
        value = F.array_max(F.slice(scores, 1, st.first))
    else:
        used = F.slice(scores, 1, st.first) if st.first else scores
        zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("top"))

        def step(a: Column, x: Column) -> Column:
            s = F.greatest(F.lit(0.0), a["s"] + x - F.lit(st.reference) - F.lit(st.slack))
            return F.struct(s.alias("s"), F.greatest(a["top"], s).alias("top"))

        value = F.aggregate(used, zero, step, lambda a: a["top"])
    return F.coalesce(value, F.lit(0.0))


def trajectories(steps: DataFrame, strategy: Strategy | str, key: str = "sample_index", order: str = "step_index", score: str = "score", label: str = "trajectory_label", meta: tuple[str, ...] = ()) -> DataFrame:
    """One row a trajectory: score, n_steps, label, and the first step's meta columns. Labels that differ are an error.

    Combinable aggregates do for max, mean and first_exceed; the others collect
    a trajectory's scores, which one row can hold.
    """
    st = parse_strategy(strategy) if isinstance(strategy, str) else strategy
    if st.name == "max":
        value = F.coalesce(F.max(score), F.lit(0.0))
    elif st.name == "mean":
        value = F.coalesce(F.avg(score), F.lit(0.0))
    else:
        ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(score).alias("s")))), lambda x: x["s"])
        value = aggregate_scores(ordered, st)
    low, high = F.min(label), F.max(label)
    same = F.when(low.eqNullSafe(high), high).otherwise(F.raise_error(F.lit("a trajectory has different labels")).cast("int"))
    firsts = [F.min_by(m, order).alias(m) for m in meta]
    return steps.groupBy(key).agg(value.alias("score"), F.count(F.lit(1)).alias("n_steps"), same.alias("label"), *firsts)


def running_scores(steps: DataFrame, strategy: Strategy | str, key: str = "sample_index", order: str = "step_index", score: str = "score") -> DataFrame:
    """Steps with the trajectory's score over all steps so far, by windows alone.

    CUSUM in closed form: with P the running sum of score - reference - slack,
    S = P - min(0, least P so far); its largest value so far is the score.
    """
    st = parse_strategy(strategy) if isinstance(strategy, str) else strategy
    w = Window.partitionBy(key).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    n = F.row_number().over(w)
    s = F.col(score)
    if st.name == "max":
        value = F.max(s).over(upto)
    elif st.name == "mean":
        value = F.avg(s).over(upto)
    elif st.name == "first_exceed":
        value = F.max(F.when(F.col("_n") <= st.first, s)).over(upto)
    elif st.name == "top2_mean":
        top = F.slice(F.sort_array(F.collect_list(s).over(upto), asc=False), 1, 2)
        value = F.aggregate(top, F.lit(0.0), lambda a, x: a + x) / F.size(top)
    else:
        inside = F.lit(True) if st.first is None else F.col("_n") <= st.first
        work = steps.withColumn("_n", n).withColumn("_p", F.sum(F.when(inside, s - F.lit(st.reference) - F.lit(st.slack)).otherwise(0.0)).over(upto))
        work = work.withColumn("_s", F.col("_p") - F.least(F.lit(0.0), F.min("_p").over(upto)))
        return work.withColumn("running", F.max("_s").over(upto)).drop("_n", "_p", "_s")
    return steps.withColumn("_n", n).withColumn("running", F.coalesce(value, F.lit(0.0))).drop("_n")


def first_alerts(steps: DataFrame, strategy: Strategy | str, threshold: float, key: str = "sample_index", order: str = "step_index", score: str = "score") -> DataFrame:
    """Where each trajectory first reaches the threshold (abort) and last does (shadow)."""
    fired = running_scores(steps, strategy, key, order, score).withColumn("_hit", F.col("running") >= F.lit(threshold))
    at = F.when(F.col("_hit"), F.col(order))
    return fired.groupBy(key).agg(F.min(at).alias("first_step"), F.max(at).alias("last_step"), F.max("_hit").alias("triggered"), F.max_by("_hit", order).alias("triggered_at_end"))
