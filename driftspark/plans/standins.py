"""Domain tables over the driver's tables, in Spark and as SQL.

The driver has no tool calls, tensors or traces; these stand-ins give the
operators inputs of the right shape, the same in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.text import sample_id

#: Layers and width that an embedding of 64 is cut into.
LAYERS, HIDDEN = 4, 16
STEP_ROLE = "assistant"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    out = docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("ord"), F.coalesce("toxic", F.lit(0)).cast("int").alias("label"), "text", "source", F.lit("document").alias("kind"),
        F.col("lang").alias("sample_type"), F.concat("source", F.lit(":"), F.floor(F.col("doc_id") / 7).cast("string")).alias("split_group"),
    )
    return out.withColumn("sample_id", sample_id(F.col("source"), F.col("label"), F.col("text")))


SAMPLES = """smp AS (
    SELECT d.doc_id AS ord, coalesce(l.toxic, 0)::INT AS label, d.text, d.source, 'document' AS kind, d.lang AS sample_type,
           d.source || ':' || (d.doc_id // 7) AS split_group,
           sha1(d.source || chr(10) || coalesce(l.toxic, 0) || chr(10) || d.text) AS sample_id
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a conversation; odd ones are positives, located by places, fragments of the last reply, or text, or not at all."""
    c = table(spark, sf_dir, "conversations")
    m = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    rows = c.groupBy("conv_id").agg(m.alias("messages"))
    idx = F.when(F.col("conv_id") % 5 == 0, F.lit(None)).when(F.col("conv_id") % 7 == 0, F.array().cast("array<int>")).otherwise(F.array((F.col("conv_id") % 4 + 1).cast("int")))
    said = F.try_element_at(F.filter("messages", lambda m: m["role"] == STEP_ROLE), F.lit(-1))["content"]
    part = lambda n, k: F.when((F.col("conv_id") % 5 == 0) & (F.col("conv_id") % 3 == k), F.regexp_extract(said, r"[^\n]{1,%d}" % n, 0))
    return rows.select(
        F.col("conv_id").alias("sample_index"), (F.col("conv_id") % 2).cast("int").alias("label"), "messages", idx.cast("array<int>").alias("malicious_idx"),
        F.when(part(60, 0).isNotNull(), F.array(part(60, 0), F.lit(" "))).alias("injection_fragments"), part(30, 1).alias("injection_text"),
    )


MESSAGES = "msg AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, role, text FROM conversations)"


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(
        F.col("user_id").alias("sample_index"), (F.row_number().over(w) - 1).cast("long").alias("step_index"), (F.col("value") / (F.col("value") + 20)).alias("score"), F.col("value").alias("norm"),
        (F.col("event_type") == "error").cast("int").alias("step_label"), (F.col("user_id") % 3 == 0).cast("int").alias("trajectory_label"), F.concat(F.lit("s"), (F.col("user_id") % 4).cast("string")).alias("source"),
        F.concat(F.lit("t"), (F.col("user_id") % 2).cast("string")).alias("sample_type"), F.when(F.col("user_id") % 5 > 0, F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string"))).alias("suite_name"), "event_type", "event_id", "ts",
    )


STEPS = """st AS (
    SELECT user_id AS sample_index, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step_index, value / (value + 20) AS score, value AS norm,
           (event_type = 'error')::INT AS step_label, (user_id % 3 = 0)::INT AS trajectory_label, 's' || (user_id % 4) AS source, 't' || (user_id % 2) AS sample_type,
           CASE WHEN user_id % 5 > 0 THEN 'u' || (user_id % 5) END AS suite_name, event_type, event_id, ts
    FROM events)"""


def acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples of tensors: in blocks of ten vectors the first is the task, the one before the history, each its own post state."""
    e = table(spark, sf_dir, "embeddings")
    w = Window.partitionBy(F.floor(F.col("vec_id") / 10)).orderBy("vec_id")
    cut = lambda c: F.array(*[F.slice(c, 1 + k * HIDDEN, HIDDEN) for k in range(LAYERS)])
    rows = e.select(
        F.floor(F.col("vec_id") / 10).alias("sample_index"), (F.row_number().over(w) - 1).cast("long").alias("step_index"), F.first("embedding").over(w).alias("a"), F.lag("embedding").over(w).alias("b"),
        F.col("embedding").alias("c"), (F.col("label") < 3).cast("int").alias("label"),
    )
    return rows.where("step_index >= 2").select("sample_index", "step_index", cut("a").alias("task"), cut("b").alias("history"), cut("c").alias("post"), "label")


#: One row a vector and layer, with the changes as lists of doubles.
ACTS = """vec AS (
    SELECT vec_id // 10 AS sample_index, row_number() OVER w - 1 AS step_index, first_value(embedding) OVER w AS a, lag(embedding) OVER w AS b, embedding AS c, (label < 3)::INT AS label
    FROM embeddings WINDOW w AS (PARTITION BY vec_id // 10 ORDER BY vec_id)
), lay AS (
    SELECT sample_index, step_index, label, k AS layer,
           [c[k * 16 + i]::DOUBLE - b[k * 16 + i]::DOUBLE FOR i IN range(1, 17)] AS inc,
           [c[k * 16 + i]::DOUBLE - a[k * 16 + i]::DOUBLE FOR i IN range(1, 17)] AS "glob",
           [b[k * 16 + i]::DOUBLE - a[k * 16 + i]::DOUBLE FOR i IN range(1, 17)] AS prog
    FROM vec, (SELECT unnest(range(0, 4)) AS k) WHERE step_index >= 2
), nrm AS (
    SELECT *, sqrt(list_sum([x * x FOR x IN inc])) AS inc_norm, sqrt(list_sum([x * x FOR x IN "glob"])) AS glob_norm, sqrt(list_sum([x * x FOR x IN prog])) AS hist_norm,
           list_sum([inc[i] * "glob"[i] FOR i IN range(1, 17)]) AS ig
    FROM lay
), rel AS (
    SELECT *, inc_norm / (hist_norm + 1e-6) AS rel_norm, ig / (greatest(inc_norm, 1e-8) * greatest(glob_norm, 1e-8)) AS cosine FROM nrm)"""


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    named = lambda p, n: F.concat(F.lit(p), (k % n).cast("string"))
    maybe = lambda n, m, yes: F.when(k % n != 0, k % m < yes)
    return table(spark, sf_dir, "orders").select(
        F.when(k % 11 > 0, named("suite", 4)).alias("suite_name"), F.when(k % 6 == 0, F.concat(F.lit("injection_task_"), (k % 9).cast("string"))).otherwise(named("user_task_", 9)).alias("user_task_id"),
        F.when(k % 3 > 0, named("injection_task_", 5)).alias("injection_task_id"), F.when(k % 3 == 0, F.when(k % 2 == 0, "none")).otherwise(named("attack", 3)).alias("attack_type"),
        maybe(13, 5, 3).alias("utility"), maybe(17, 7, 2).alias("security"), maybe(19, 4, 1).alias("triggered"), (k % 23 == 0).alias("aborted"), F.when(k % 4 == 0, (k % 6).cast("int")).alias("trigger_step"),
        F.when(k % 29 == 0, "run ended: task drift at step").alias("error"), F.when(k % 4 == 0, F.array((k % 10) / F.lit(10.0))).alias("scores"), k.alias("trace_id"),
    )


TRACES = """tr AS (
    SELECT CASE WHEN k % 11 > 0 THEN 'suite' || (k % 4) END AS suite_name, CASE WHEN k % 6 = 0 THEN 'injection_task_' || (k % 9) ELSE 'user_task_' || (k % 9) END AS user_task_id,
           CASE WHEN k % 3 > 0 THEN 'injection_task_' || (k % 5) END AS injection_task_id, CASE WHEN k % 3 = 0 THEN CASE WHEN k % 2 = 0 THEN 'none' END ELSE 'attack' || (k % 3) END AS attack_type,
           CASE WHEN k % 13 <> 0 THEN k % 5 < 3 END AS utility, CASE WHEN k % 17 <> 0 THEN k % 7 < 2 END AS security, CASE WHEN k % 19 <> 0 THEN k % 4 < 1 END AS triggered, k % 23 = 0 AS aborted,
           CASE WHEN k % 4 = 0 THEN (k % 6)::INT END AS trigger_step, CASE WHEN k % 29 = 0 THEN 'run ended: task drift at step' END AS error, CASE WHEN k % 4 = 0 THEN [(k % 10) / 10.0::DOUBLE] END AS scores, k AS trace_id
    FROM (SELECT o_orderkey AS k FROM orders))"""
