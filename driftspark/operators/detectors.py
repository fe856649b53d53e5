"""Detectors: pipelines that are fitted on step features and judged by trajectories."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from .aggregate import trajectories
from .features import Baseline, FeatureConfig, anchors, collected_baseline, drift, featurize
from .metrics import balanced_weights, bundle, choose_threshold, confusion, curve, group_diagnostics, training_mask, tradeoffs
from .portable import exported

VERSION = 2


@dataclass
class Detector:
    """A fitted pipeline with what belongs to it; saved as a model folder and one JSON text, never pickled.

    One that was fitted by fit_drift() also has the anchors, the benign baseline
    and the configuration that new steps are featurised by.
    """

    kind: str
    model: PipelineModel
    threshold: float = 0.5
    aggregation: str = "max"
    params: dict = field(default_factory=dict)
    metrics: dict = field(default_factory=dict)
    config: FeatureConfig | None = None
    layers: int = 0
    anchors: dict[str, list[list[float]]] | None = None
    baseline: Baseline | None = None

    def features(self, acts: DataFrame) -> DataFrame:
        """Steps' triples of tensors with the features that the model was fitted on."""
        if self.config is None:
            raise ValueError("this detector was fitted on ready features")
        return featurize(acts, self.config, self.layers, self.anchors, self.baseline)

    def score(self, rows: DataFrame, features: str = "features") -> DataFrame:
        """rows with the probability of label 1."""
        out = self.model.transform(rows.withColumn("_x", array_to_vector(F.col(features))))
        return out.withColumn("score", vector_to_array("probability")[1]).drop("_x", "_z", "rawPrediction", "probability", "prediction")

    def save(self, spark: SparkSession, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        about = {"kind": self.kind, "threshold": self.threshold, "aggregation": self.aggregation, "params": self.params, "metrics": self.metrics, "version": VERSION}
        about |= {"config": vars(self.config) if self.config else None, "layers": self.layers, "anchors": self.anchors, "baseline": self.baseline, "numbers": exported(spark, self.model)}
        spark.createDataFrame([(json.dumps(about, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/detector.json")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Detector:
        about = json.loads(spark.read.text(f"{path}/detector.json").first()[0])
        if about.get("version") != VERSION:
            raise ValueError(f"detector of version {about.get('version')!r}; {VERSION} is needed")
        baseline = about["baseline"] and {n: {int(k): tuple(v) for k, v in by.items()} for n, by in about["baseline"].items()}
        config = about["config"] and FeatureConfig(**about["config"])
        return Detector(about["kind"], PipelineModel.load(f"{path}/model"), about["threshold"], about["aggregation"], about["params"], about["metrics"], config, about["layers"], about["anchors"], baseline)


def estimator(kind: str, rows: int = 1, **params):
    """gbt (the main one), logistic (minimal norms), forest (anchor distances), scaled_logistic (anchor differences)."""
    common = {"featuresCol": "_x", "labelCol": "label", "weightCol": "weight"}
    if kind == "gbt":
        return [GBTClassifier(**common, maxIter=params.get("iterations", 200), stepSize=params.get("rate", 0.05), maxDepth=params.get("depth", 5), seed=params.get("seed", 42))]
    if kind == "logistic":
        return [LogisticRegression(**common, maxIter=1000, standardization=False, regParam=1 / (params.get("c", 1.0) * rows))]
    if kind == "forest":
        return [RandomForestClassifier(**common, numTrees=params.get("trees", 200), maxDepth=10, minInstancesPerNode=5, seed=params.get("seed", 42))]
    if kind == "scaled_logistic":
        scaler = StandardScaler(withMean=True, withStd=True, inputCol="_x", outputCol="_z")
        return [scaler, LogisticRegression(**{**common, "featuresCol": "_z"}, maxIter=1000, standardization=False, regParam=1 / (params.get("c", 0.01) * rows))]
    raise ValueError(f"unknown detector {kind!r}")


def fit(train: DataFrame, kind: str = "gbt", features: str = "features", **params) -> Detector:
    """A detector from labelled rows: -1 is left out, classes are balanced by weight."""
    kept, _ = training_mask(train)
    rows = balanced_weights(kept.withColumn("_x", array_to_vector(F.col(features))).withColumn("label", F.col("label").cast("double")))
    # Fitting reads the rows many times; features are dear.
    rows = rows.persist()
    try:
        n = rows.count() if "logistic" in kind else 1
        return Detector(kind, Pipeline(stages=estimator(kind, max(1, n), **params)).fit(rows), params=params)
    finally:
        rows.unpersist()


def fit_drift(train: DataFrame, cfg: FeatureConfig = FeatureConfig(), n_anchors: int = 100, seed: int = 42, kind: str = "gbt", **params) -> Detector:
    """A detector on the whole feature vector of triples of tensors, with all that featurises new ones.

    Anchors are the changes of the n_anchors benign steps that hash lowest; the
    baseline is that of all benign steps.
    """
    layers = train.limit(1).select(F.size("post").alias("n")).first()
    if layers is None:
        raise ValueError("there are no steps to train on")
    n = layers["n"] if cfg.mode == "concat" else 1
    rows = drift(train, cfg.mode)
    order = F.sha1(F.concat_ws("|", F.lit(str(seed)), "sample_index", "step_index"))
    anchored = {c: anchors(rows, F.flatten(c), n_anchors, order) for c in ("inc", "glob")} if cfg.use_anchors else None
    baseline = collected_baseline(rows) if cfg.self_baseline else None
    detector = fit(featurize(train, cfg, n, anchored, baseline), kind, seed=seed, **params)
    detector.config, detector.layers, detector.anchors, detector.baseline = cfg, n, anchored, baseline
    return detector


def calibrate(detector: Detector, val: DataFrame, aggregation: str = "max", target_tpr: float = 0.95, max_fpr: float | None = None) -> Detector:
    """Sets the threshold by validation trajectories, and keeps their metrics; the model scores the rows once."""
    c = curve(trajectories(detector.score(val), aggregation))
    detector.aggregation = aggregation
    detector.threshold = choose_threshold(c, target_tpr, max_fpr).first()[0]
    detector.metrics["val"] = bundle(c, detector.threshold).first().asDict()
    return detector


def evaluate(detector: Detector, test: DataFrame, groups: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Metrics of test trajectories at the frozen threshold."""
    runs = trajectories(detector.score(test), detector.aggregation, meta=groups)
    c = curve(runs)
    out = {"metrics": bundle(c, detector.threshold), "confusion": confusion(c, detector.threshold), "tradeoffs": tradeoffs(c, [0.01, 0.05, 0.1, 0.2])}
    if groups:
        out["groups"] = group_diagnostics(runs, detector.threshold, groups)
    return out
