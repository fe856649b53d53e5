"""Cutting lineage by checkpoints in the folder that the cluster shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Has the driver's JVM delete path when it ends."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_marked: set[str] = set()


def checkpoint_dir(spark: SparkSession) -> str:
    """This application's part of the cluster's shared folder, which goes when the application ends; a local one only where none is set."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            shared = tempfile.mkdtemp(prefix="driftspark-checkpoint-")
            delete_at_exit(spark, shared)
        sc.setCheckpointDir(shared)
        current = sc.getCheckpointDir()
    if current not in _marked:
        _marked.add(current)
        delete_at_exit(spark, current)
    return current


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder, without its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
