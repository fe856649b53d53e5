"""Online scoring: one step at a time, with the trajectory's past in keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.aggregate import Strategy, parse_strategy
from ..operators.detectors import Detector
from ..operators.features import NORMS, Baseline, FeatureConfig, assemble, drift, with_anchors
from ..operators.portable import Portable, exported

OUTPUT = "sample_index long, step_index long, z array<double>, score double, running double, triggered boolean, trigger_step int, aborted boolean"
STATE = "n long, mean array<double>, m2 array<double>, steps int, low double, total double, count long, best double, second double, done boolean, trigger int"


class Past:
    """What a trajectory's next step needs of all earlier ones: moments of its norms (Welford) and the running score.

    As large as four norms a layer, for every aggregation: the two largest scores,
    their sum and number, the running CUSUM sum and its peak.
    """

    def __init__(self, state: tuple | None = None) -> None:
        values = state or (0, [], [], 0, 0.0, 0.0, 0, float("-inf"), float("-inf"), False, -1)
        (self.n, mean, m2, self.steps, self.sum, self.total, self.count, self.best, self.second, self.done, self.trigger) = values
        self.mean, self.m2 = np.array(mean, float), np.array(m2, float)

    def tuple(self) -> tuple:
        return (self.n, self.mean.tolist(), self.m2.tolist(), self.steps, self.sum, self.total, self.count, self.best, self.second, self.done, self.trigger)

    def z(self, x: np.ndarray, baseline: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """Against strictly earlier steps; with fewer than two against the baseline's means and deviations, 0 without one."""
        if self.n >= 2:
            return (x - self.mean) / (np.sqrt(np.maximum(self.m2, 0) / self.n) + 1e-6)
        return np.zeros(len(x)) if baseline is None else (x - baseline[0]) / (baseline[1] + 1e-6)

    def learn(self, x: np.ndarray) -> None:
        if not self.n:
            self.mean, self.m2 = np.zeros(len(x)), np.zeros(len(x))
        self.n += 1
        d = x - self.mean
        self.mean = self.mean + d / self.n
        self.m2 = self.m2 + d * (x - self.mean)

    def running(self, score: float, st: Strategy) -> float:
        self.steps += 1
        if st.first is not None and self.steps > st.first and st.name in ("first_exceed", "cusum"):
            return max(self.best, 0.0) if st.name == "cusum" else self.best
        if st.name == "cusum":
            self.sum = max(0.0, self.sum + score - st.reference - st.slack)
            self.best = max(self.best, self.sum, 0.0)
            return self.best
        self.total, self.count = self.total + score, self.count + 1
        if score > self.best:
            self.best, self.second = score, self.best
        else:
            self.second = max(self.second, score)
        if st.name == "mean":
            return self.total / self.count
        if st.name == "top2_mean":
            return (self.best + self.second) / 2 if self.count > 1 else self.best
        return self.best


class Live:
    """A detector's model and baseline, as a worker applies them to a step."""

    def __init__(self, numbers: dict, self_baseline: bool, baseline: Baseline | None, layers: int) -> None:
        self.numbers, self.self_baseline = numbers, self_baseline
        self.baseline = None
        if baseline:
            # a norm without a baseline has z 0: mean 0 and an endless deviation
            flat = [baseline.get(n, {}).get(k, (0.0, float("inf"))) for n in NORMS for k in range(layers)]
            self.baseline = tuple(np.array(x) for x in zip(*flat))
        self.model: Portable | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"model": None}

    def score(self, parts: np.ndarray, z: np.ndarray) -> float:
        if self.model is None:
            self.model = Portable(self.numbers)
        return float(self.model.score(np.concatenate([parts, z]) if self.self_baseline else parts)[0])


def advance(past: Past, rows: pd.DataFrame, st: Strategy, threshold: float, abort: bool, live: Live | None = None) -> pd.DataFrame:
    """Scores a trajectory's new steps in order; after an abort nothing more comes out."""
    out = []
    for r in rows.sort_values("step_index").itertuples(index=False):
        if past.done:
            break
        norms = np.asarray(r.norms, float)
        z = past.z(norms, live.baseline if live else None)
        past.learn(norms)
        score = live.score(np.asarray(r.parts, float), z) if live else r.score
        running = past.running(score, st)
        hit = running >= threshold
        if hit:
            past.trigger = past.steps - 1
        past.done = abort and hit
        out.append((r.sample_index, r.step_index, z.tolist(), score, running, hit, past.trigger if hit else None, past.done))
    names = [x.split()[0] for x in OUTPUT.split(", ")]
    return pd.DataFrame(out, columns=names).astype({"trigger_step": "Int32"})


def with_norms(steps: DataFrame) -> DataFrame:
    return steps if "norms" in steps.columns else steps.withColumn("norms", F.array(F.col("norm").cast("double")))


def score_stream(steps: DataFrame, aggregation: str = "max", threshold: float = 0.5, abort: bool = False, role: str | None = "tool", idle: str | None = None, live: Live | None = None) -> DataFrame:
    """A stream of steps (sample_index, step_index, norm or norms, score, role) with running scores and alerts.

    With live, steps have parts instead of a score, and the model scores these and
    the z-scores of norms against the trajectory's past; see score_live(). Other
    roles pass by without touching the state. With `idle` (a duration; the stream
    then needs a watermark) the state of a trajectory goes when nothing came for
    that long. Within a micro-batch steps are put in order; across micro-batches
    they must arrive in order.
    """
    st = parse_strategy(aggregation)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        past = Past(state.get if state.exists else None)
        rows = pd.concat(list(frames))
        out = advance(past, rows, st, threshold, abort, live)
        state.update(past.tuple())
        if idle is not None:
            state.setTimeoutTimestamp(max(int(rows["event_ms"].max()), state.getCurrentWatermarkMs()) + int(pd.Timedelta(idle).total_seconds() * 1000))
        if len(out):
            yield out

    used = with_norms(steps.where(F.col("role") == role) if role is not None else steps)
    timeout = GroupStateTimeout.NoTimeout
    if idle is not None:
        used, timeout = used.withColumn("event_ms", F.unix_millis("ts")), GroupStateTimeout.EventTimeTimeout
    return used.groupBy("sample_index").applyInPandasWithState(run, OUTPUT, STATE, "append", timeout)


def score_live(acts: DataFrame, detector: Detector, threshold: float | None = None, abort: bool = False, idle: str | None = None) -> DataFrame:
    """A stream of triples of tensors (sample_index, step_index, task, history, post), each step scored as it comes.

    Changes, norms and distances to anchors are columns; the state of a trajectory
    has the moments of its four norms a layer, by which the worker makes the
    z-scores (the detector's baseline stands in for the first two steps), applies
    the model and goes on with the trajectory's score.
    """
    cfg = detector.config
    if cfg is None:
        raise ValueError("this detector was fitted on ready features")
    rows = drift(acts, cfg.mode)
    if cfg.use_anchors:
        rows = with_anchors(rows, detector.anchors)
    rows = assemble(rows, FeatureConfig(cfg.mode, cfg.use_anchors, False), "parts").withColumn("norms", F.concat(*NORMS))
    kept = ["sample_index", "step_index", "parts", "norms", *(["ts"] if idle is not None else [])]
    live = Live(exported(acts.sparkSession, detector.model), cfg.self_baseline, detector.baseline, detector.layers)
    return score_stream(rows.select(*kept), detector.aggregation, detector.threshold if threshold is None else threshold, abort, None, idle, live)


def score_batch(steps: DataFrame, aggregation: str = "max", threshold: float = 0.5, abort: bool = False) -> DataFrame:
    """score_stream() over a finished table, by one pass a trajectory."""
    st = parse_strategy(aggregation)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return advance(Past(), rows, st, threshold, abort)

    return with_norms(steps).groupBy("sample_index").applyInPandas(run, OUTPUT)


def deduplicated(stream: DataFrame, event: str = "event_id", ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """A stream without repeated events within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([event])


def windowed(stream: DataFrame, width: str = "10 minutes", late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Alerts by tumbling window of a stream with score columns."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width)).agg(F.count(F.lit(1)).alias("steps"), F.max("score").alias("top"))
