"""Fitted detectors and encoders, which no SQL says, so the driver checks rows only; and a stream."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import detectors as D, encode as E, features as X, steps as S
from ..lineage import checkpoint_dir, delete
from ..streaming.scorer import score_stream
from .registry import query
from .standins import STEP_ROLE, STEPS, acts, chats, steps
from .vector_queries import N_ANCHORS, drift, flat, order


def judged(detector: D.Detector, rows):
    """Scores of all rows by a calibrated detector, a trajectory a row."""
    from ..operators.aggregate import trajectories

    D.calibrate(detector, rows)
    return trajectories(detector.score(rows), detector.aggregation).withColumn("flagged", F.col("score") >= detector.threshold)


def labelled(rows):
    """Trajectory labels, as a trajectory with any positive step is one."""
    from pyspark.sql import Window

    return rows.withColumn("trajectory_label", F.max("label").over(Window.partitionBy("sample_index")))


@query()
def train_gbt(spark, d):
    """The main detector on the whole feature vector; 10 iterations here, 200 by default."""
    detector = D.fit_drift(acts(spark, d), n_anchors=N_ANCHORS, iterations=10)
    return judged(detector, labelled(detector.features(acts(spark, d)).select("sample_index", "step_index", "label", "features")))


@query()
def train_minimal_norm(spark, d):
    rows = X.minimal_norms(drift(spark, d)).withColumn("features", F.array("inc_mean", "glob_mean"))
    rows = labelled(rows.select("sample_index", "step_index", "label", "features"))
    return judged(D.fit(rows, "logistic"), rows)


@query()
def train_forest(spark, d):
    rows = acts(spark, d)
    out = X.anchor_distances(rows.select("sample_index", "step_index", "label", flat("post").alias("v")), F.col("v"), X.anchor_table(rows, flat("post"), N_ANCHORS, order()), "features")
    out = labelled(out.drop("v"))
    return judged(D.fit(out, "forest", trees=20), out)


@query()
def train_logreg_diff(spark, d):
    rows = acts(spark, d)
    out = X.anchor_differences(rows.select("sample_index", "step_index", "label", flat("post").alias("v")), F.col("v"), X.anchor_table(rows, flat("post"), N_ANCHORS, order()), "features")
    out = labelled(out.drop("v"))
    return judged(D.fit(out, "scaled_logistic"), out)


@query()
def encode_steps(spark, d):
    out = E.activations(S.tool_steps(chats(spark, d), STEP_ROLE))
    return out.select("sample_index", F.col("step_index").cast("long").alias("step_index"), "label", *[F.round(V.norm(F.flatten(V.doubles(F.col(c)))), 6).alias(f"{c}_norm") for c in ("task", "history", "post")])


@query(
    """, p AS (
        SELECT sample_index, step_index, norm, score, sum(score - 0.5) OVER w AS p, count(*) OVER b AS n, avg(norm) OVER b AS m, stddev_pop(norm) OVER b AS s FROM st
        WINDOW w AS (PARTITION BY sample_index ORDER BY step_index), b AS (PARTITION BY sample_index ORDER BY step_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    ), q AS (SELECT *, p - least(0, min(p) OVER (PARTITION BY sample_index ORDER BY step_index)) AS c FROM p),
    r AS (SELECT *, max(c) OVER (PARTITION BY sample_index ORDER BY step_index) AS running FROM q),
    f AS (SELECT sample_index, min(step_index) AS first FROM r WHERE running >= 1.0 GROUP BY sample_index)
    SELECT sample_index, step_index, CASE WHEN n >= 2 AND round((norm - m) / (s + 1e-6), 4) <> 0 THEN round((norm - m) / (s + 1e-6), 4) ELSE 0.0::DOUBLE END AS z, round(score, 6) AS score, round(running, 6) AS running,
        running >= 1.0 AS triggered, CASE WHEN running >= 1.0 THEN step_index::INT END AS trigger_step, running >= 1.0 AS aborted
    FROM r LEFT JOIN f USING (sample_index) WHERE first IS NULL OR step_index <= first""",
    STEPS,
)
def stream_scores(spark, d):
    """Steps through the stream, with its input and output in the shared folder."""
    folder = f"{checkpoint_dir(spark)}/stream-{uuid4().hex}"
    rows = steps(spark, d).select("sample_index", "step_index", "norm", "score")
    rows.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
    scored = score_stream(stream, "cusum", 1.0, abort=True, role=None)
    scored.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()
    delete(spark, f"{folder}/in")
    out = spark.read.parquet(f"{folder}/out").withColumn("z", F.get("z", F.lit(0)))
    return out.withColumns({"z": F.when(F.round("z", 4) == 0, 0.0).otherwise(F.round("z", 4)), "score": F.round("score", 6), "running": F.round("running", 6)})
