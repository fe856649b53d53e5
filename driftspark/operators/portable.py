"""Fitted models as plain arrays, so that a Python worker can apply them to one step at a time."""

from __future__ import annotations

from uuid import uuid4

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, LogisticRegressionModel, RandomForestClassificationModel
from pyspark.ml.feature import StandardScalerModel
from pyspark.sql import SparkSession

from ..lineage import checkpoint_dir, delete


def exported(spark: SparkSession, model: PipelineModel) -> dict:
    """The model's numbers, as JSON can hold them."""
    out: dict = {}
    for stage in model.stages:
        if isinstance(stage, StandardScalerModel):
            std = np.asarray(stage.std.toArray())
            out |= {"mean": stage.mean.toArray().tolist(), "factor": np.where(std > 0, 1 / np.where(std > 0, std, 1), 0).tolist()}
        elif isinstance(stage, LogisticRegressionModel):
            out |= {"weights": stage.coefficients.toArray().tolist(), "intercept": float(stage.intercept)}
        elif isinstance(stage, (GBTClassificationModel, RandomForestClassificationModel)):
            path = f"{checkpoint_dir(spark)}/model-{uuid4().hex}"
            stage.write().save(path)
            nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").orderBy("treeID", "id").collect()
            delete(spark, path)
            boosted = isinstance(stage, GBTClassificationModel)
            trees: list[list] = [[] for _ in stage.treeWeights]
            for r in nodes:
                leaf = r.leftChild < 0
                value = r.prediction if boosted else r.impurityStats[1] / max(sum(r.impurityStats), 1e-300)
                trees[r.treeID].append([-1, 0.0, r.id, r.id, value] if leaf else [r.split.featureIndex, r.split.leftCategoriesOrThreshold[0], r.leftChild, r.rightChild, value])
            out |= {"trees": trees, "tree_weights": list(stage.treeWeights), "boosted": boosted}
        else:
            raise ValueError(f"no export of {type(stage).__name__}")
    return out


class Portable:
    """An exported model; score() gives the probability of label 1 of each row."""

    def __init__(self, numbers: dict) -> None:
        self.numbers = numbers
        if "trees" in numbers:
            width = max(len(t) for t in numbers["trees"])
            table = np.zeros((len(numbers["trees"]), width, 5))
            for t, rows in enumerate(numbers["trees"]):
                table[t, : len(rows)] = rows
            self.feature, self.left, self.right = (table[:, :, i].astype(np.int64) for i in (0, 2, 3))
            self.threshold, self.value = table[:, :, 1], table[:, :, 4]

    def score(self, x: np.ndarray) -> np.ndarray:
        x = np.atleast_2d(np.asarray(x, float))
        if "mean" in self.numbers:
            x = (x - self.numbers["mean"]) * self.numbers["factor"]
        if "weights" in self.numbers:
            return 1 / (1 + np.exp(-(x @ np.asarray(self.numbers["weights"]) + self.numbers["intercept"])))
        rows, trees = np.arange(len(x))[:, None], np.arange(len(self.feature))[None]
        node = np.zeros((len(x), len(self.feature)), np.int64)
        while True:
            f = self.feature[trees, node]
            if (f < 0).all():
                break
            down = np.where(x[rows, np.maximum(f, 0)] <= self.threshold[trees, node], self.left[trees, node], self.right[trees, node])
            node = np.where(f < 0, node, down)
        weights = np.asarray(self.numbers["tree_weights"])
        total = self.value[trees, node] @ weights
        return 1 / (1 + np.exp(-2 * total)) if self.numbers["boosted"] else total / weights.sum()
