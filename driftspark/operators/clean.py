"""Filters, dedup, caps and counts over samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import render, sample_id, strip, truthy
from .ranking import hash_rank


def has_locator(explicit: Column, parts: Column, text: Column) -> Column:
    return F.coalesce(F.size(explicit) > 0, F.lit(False)) | F.coalesce(F.size(parts) > 0, F.lit(False)) | truthy(text)


def drop_unlocatable(samples: DataFrame, located: Column, label: str = "label") -> tuple[DataFrame, DataFrame]:
    """Samples without the positives that nothing locates, and their number by source."""
    gone = (F.col(label) == 1) & ~located
    dropped = samples.where(gone).groupBy("source").agg(F.count(F.lit(1)).alias("dropped"))
    return samples.where(~F.coalesce(gone, F.lit(False))), dropped


def with_id(samples: DataFrame) -> DataFrame:
    return samples.withColumn("sample_id", sample_id(F.col("source"), F.col("label"), F.col("text")))


def first_of_each(samples: DataFrame, key: str = "sample_id", order: str = "ord") -> DataFrame:
    """One row of each key, the first by order. A combinable aggregate: copies meet as one row a task."""
    names = samples.columns
    best = samples.groupBy(key).agg(F.min_by(F.struct(*names), F.col(order)).alias("_best"))
    return best.select(*[F.col("_best").getField(c).alias(c) for c in names])


def balanced_cap(samples: DataFrame, most: int, order: Column, label: str = "label") -> DataFrame:
    """At most `most` rows: half benign and half malicious by order, filled up with the others; out_rank tells the output order.

    Only rows that can be chosen, at most 2 * most, reach the final sort.
    """
    half = most // 2
    ranked = hash_rank(samples, [label], order, "label_rank", "label_size")
    full = F.when(F.col(label) == 0, F.lit(0)).when(F.col(label) == 1, F.lit(1))
    room = F.when(F.col(label) == 0, F.lit(half)).when(F.col(label) == 1, F.lit(most - half)).otherwise(0)
    first = F.when(F.col("label_rank") <= room, full).otherwise(2)
    able = ranked.withColumns({"_first": first, "_order": order}).where(F.col("label_rank") <= most)
    kept = able.orderBy("_first", F.when(F.col("_first") == 2, F.lit(0)).otherwise(F.col("label_rank")), "_order").limit(most)
    return kept.drop("_first", "_order", "label_rank", "label_size")


def validate(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid samples, back-filled, and the rejected with a reason.

    An empty text is rendered from the messages; no messages become one user
    message. Then the label must be 0 or 1 and the texts not empty.
    """
    rendered = F.when(strip(F.coalesce(F.col("text"), F.lit(""))) == "", render(F.col("messages"))).otherwise(F.col("text"))
    filled = samples.withColumn("text", F.coalesce(rendered, F.lit("")))
    kind = samples.schema["messages"].dataType.simpleString()
    one = F.array(F.named_struct(F.lit("role"), F.lit("user"), F.lit("content"), F.col("text"))).cast("array<struct<role:string,content:string>>")
    fields = samples.schema["messages"].dataType.elementType.names
    lone = F.transform(one, lambda m: F.struct(*[(m[f] if f in ("role", "content") else F.lit(None)).alias(f) for f in fields])).cast(kind)
    filled = filled.withColumn("messages", F.when(F.coalesce(F.size("messages"), F.lit(0)) == 0, lone).otherwise(F.col("messages")))
    reason = F.when(~F.coalesce(F.col("label").isin(0, 1), F.lit(False)), "label")
    for name in ("text", "source", "kind", "sample_type"):
        reason = reason.when(strip(F.coalesce(F.col(name), F.lit(""))) == "", name)
    checked = filled.withColumn("reason", reason)
    return checked.where("reason is null").drop("reason"), checked.where("reason is not null")


def label_counts(samples: DataFrame) -> DataFrame:
    return samples.groupBy("source", "label").agg(F.count(F.lit(1)).alias("n"))


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """Counts by source and label on both sides, and their ratio."""
    b, a = label_counts(before).withColumnRenamed("n", "n_before"), label_counts(after).withColumnRenamed("n", "n_after")
    both = b.join(a, ["source", "label"], "full_outer").fillna(0, ["n_before", "n_after"])
    return both.withColumn("ratio", F.when(F.col("n_before") > 0, F.col("n_after") / F.col("n_before")))


def payload_pool(*sources: DataFrame) -> DataFrame:
    """Distinct stripped payloads of all (payload, ord) sources in order: payload, payload_rank from 0."""
    from functools import reduce

    parts = [s.select(F.lit(i).alias("src"), "ord", strip(F.col("payload")).alias("payload")) for i, s in enumerate(sources)]
    union = reduce(DataFrame.unionByName, parts).where("payload <> ''")
    firsts = union.groupBy("payload").agg(F.min(F.struct("src", "ord")).alias("at"))
    # Positions by hash: the pool's order does not matter to who draws from it.
    ranked = hash_rank(firsts, [], F.sha1("payload"), "payload_rank", "pool_size")
    return ranked.select("payload", (F.col("payload_rank") - 1).alias("payload_rank"), "pool_size")
