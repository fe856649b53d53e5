"""Writers: samples, activations with resume, and metrics."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.steps import MODE, check_mode, resume


def write_samples(samples: DataFrame, path: str, by: str | None = "split") -> None:
    """One JSON line a sample, in a folder a split."""
    writer = samples.write.mode("overwrite")
    (writer.partitionBy(by) if by in samples.columns else writer).json(path)


def existing(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def write_activations(steps: DataFrame, encode, path: str, shard_rows: int = 500, again: bool = False, mode: str = MODE) -> dict[str, int]:
    """Encodes the steps that path does not hold yet and appends them; `again` starts anew.

    Rows are keyed, so an interrupted run that is repeated makes only what is
    missing. Rows made in another mode are an error.
    """
    spark = steps.sparkSession
    done = None if again else existing(spark, path)
    if done is not None:
        check_mode(done, mode)
    todo = resume(steps, done) if done is not None else steps
    total = steps.count()
    fresh = todo.count()
    if fresh or again:
        encode(todo).withColumn("extraction_mode", F.lit(mode)).write.mode("overwrite" if again else "append").option("maxRecordsPerFile", shard_rows).parquet(path)
    return {"total": total, "skipped": total - fresh, "extracted": fresh}


def read_activations(spark: SparkSession, path: str, tensors: tuple[str, ...] = ("task", "history", "post")) -> DataFrame:
    """Stored activations; a row without one of its tensors is an error when it is read."""
    rows = spark.read.parquet(path)
    for t in tensors:
        rows = rows.withColumn(t, F.when(F.col(t).isNull(), F.raise_error(F.lit(f"a row lacks its {t} tensor")).cast(rows.schema[t].dataType)).otherwise(F.col(t)))
    return rows


def write_metrics(metrics: DataFrame, path: str) -> None:
    """A small table as JSON."""
    metrics.coalesce(1).write.mode("overwrite").json(path)
