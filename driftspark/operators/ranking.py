"""Ranks and running sums over large groups, without any task that holds a whole group.

A plain window over a handful of strata sends each stratum to one task. Here rows
are cut into ordered buckets: totals of the buckets give what comes before each,
and windows run within a bucket only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Leading hex digits of a hash that make a bucket.
DIGITS = 3


def hash_rank(df: DataFrame, strata: Sequence[str], order: Column, rank: str = "rank", size: str = "size") -> DataFrame:
    """df with each row's rank from 1 in its stratum by a hex hash, and the stratum's size."""
    work = df.withColumns({"_order": order, "_bucket": F.substring(order, 1, DIGITS)})
    key = [*strata, "_bucket"]
    totals = work.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*strata).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumns({"_before": F.coalesce(F.sum("_n").over(before), F.lit(0)), size: F.sum("_n").over(Window.partitionBy(*strata))})
    marks = totals.select(*[F.col(k).alias(f"_{k}_") for k in key], "_before", size)
    same = [F.col(k).eqNullSafe(F.col(f"_{k}_")) for k in key]
    joined = work.join(marks, same)
    within = F.row_number().over(Window.partitionBy(*key).orderBy("_order"))
    return joined.withColumn(rank, (F.col("_before") + within).cast("long")).select(*df.columns, rank, F.col(size).cast("long"))
