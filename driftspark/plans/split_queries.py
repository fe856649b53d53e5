"""Dedup, caps, splits and subsets of samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean, splits as P, steps as S
from .registry import query
from .standins import SAMPLES, STEPS, samples, steps, table


def cut_sql(n: str, ratio: float) -> str:
    return f"CASE WHEN {n} = 1 THEN 1 ELSE greatest(1, least({n} - 1, round_even({n} * {ratio}::DOUBLE, 0)::BIGINT)) END"


def h(seed: int, key: str) -> str:
    return f"sha1('{seed}|' || {key})"


@query("SELECT min(ord) AS ord, sample_id FROM smp GROUP BY sample_id", SAMPLES)
def sample_id_dedup(spark, d):
    return clean.first_of_each(samples(spark, d).select("ord", "sample_id", "source", "label")).select("ord", "sample_id")


@query("SELECT source, label, count(*) AS n FROM smp GROUP BY source, label", SAMPLES)
def source_label_counts(spark, d):
    return clean.label_counts(samples(spark, d))


@query(
    """, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sha1(sample_id || ord)) AS k FROM smp),
    p AS (SELECT *, CASE WHEN label = 0 AND k <= 60 THEN 0 WHEN label = 1 AND k <= 60 THEN 1 ELSE 2 END AS part FROM r)
    SELECT ord, label FROM p ORDER BY part, CASE WHEN part < 2 THEN k ELSE 0 END, sha1(sample_id || ord) LIMIT 120""",
    SAMPLES,
)
def balanced_cap(spark, d):
    return clean.balanced_cap(samples(spark, d), 120, F.sha1(F.concat("sample_id", F.col("ord").cast("string")))).select("ord", "label")


FIRST = "fst AS (SELECT * FROM smp QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY ord) = 1)"


def distinct(spark, d):
    return clean.first_of_each(samples(spark, d).drop("text"))


@query(
    f""", r AS (SELECT ord, row_number() OVER (PARTITION BY source, label ORDER BY {h(42, "sample_id")}) AS k, count(*) OVER (PARTITION BY source, label) AS n FROM fst)
    SELECT ord, CASE WHEN k <= {cut_sql("n", 0.8)} THEN 'left' ELSE 'right' END AS side FROM r""",
    SAMPLES, FIRST,
)
def stratified_split(spark, d):
    return P.stratified(distinct(spark, d), 0.8).select("ord", "side")


COMPOSED = """cmp AS (
    SELECT split_group, string_agg(part, ',' ORDER BY part) AS composition, sum(n) AS members
    FROM (SELECT split_group, source || '/' || label || '/' || count(*) AS part, count(*) AS n FROM fst GROUP BY split_group, source, label) GROUP BY split_group)"""


@query("SELECT split_group, composition, members::BIGINT AS members FROM cmp", SAMPLES, FIRST, COMPOSED)
def group_compositions(spark, d):
    return P.compositions(distinct(spark, d), "split_group")


@query(
    f""", r AS (SELECT split_group, row_number() OVER (PARTITION BY composition ORDER BY {h(42, "split_group")}) AS k, count(*) OVER (PARTITION BY composition) AS n FROM cmp)
    SELECT ord, CASE WHEN k <= {cut_sql("n", 0.8)} THEN 'left' ELSE 'right' END AS side FROM fst JOIN r USING (split_group)""",
    SAMPLES, FIRST, COMPOSED,
)
def group_split(spark, d):
    return P.grouped(distinct(spark, d), 0.8).select("ord", "side")


RANKED = f"rnk AS (SELECT split_group, row_number() OVER (ORDER BY {h(42, 'split_group')}) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT split_group FROM fst))"


@query(f"SELECT ord, CASE WHEN k <= {cut_sql('n', 0.8)} THEN 'train' ELSE 'test' END AS split FROM fst JOIN rnk USING (split_group)", SAMPLES, FIRST, RANKED)
def held_out_split(spark, d):
    return P.held_out(distinct(spark, d), 0.8).select("ord", "split")


THREE = """thr AS (
    SELECT fst.*, CASE WHEN k <= greatest(1, least(pool - 1, round_even(pool * 0.8::DOUBLE, 0)::BIGINT)) THEN 'train' WHEN k <= pool THEN 'val' ELSE 'test' END AS split
    FROM fst JOIN (SELECT *, greatest(2, least(n - 1, round_even(n * 0.8::DOUBLE, 0)::BIGINT)) AS pool FROM rnk) USING (split_group))"""


@query("SELECT ord, split FROM thr", SAMPLES, FIRST, RANKED, THREE)
def three_way_split(spark, d):
    return P.three_way(distinct(spark, d)).select("ord", "split")


@query("SELECT split, label, count(*) AS n FROM thr GROUP BY split, label", SAMPLES, FIRST, RANKED, THREE)
def split_label_counts(spark, d):
    return P.three_way(distinct(spark, d)).groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT s.split, l.label AS missing FROM (SELECT DISTINCT split FROM thr WHERE label = 0 OR split <> 'val') s, (SELECT unnest([0, 1]) AS label) l
    WHERE NOT EXISTS (SELECT 1 FROM thr t WHERE t.split = s.split AND t.label = l.label AND (t.label = 0 OR t.split <> 'val'))""",
    SAMPLES, FIRST, RANKED, THREE,
)
def missing_labels(spark, d):
    return P.missing_labels(P.three_way(distinct(spark, d)).where("label = 0 OR split <> 'val'"))


@query(
    """SELECT sample_id, count(DISTINCT (ord % 3)) AS splits FROM smp GROUP BY sample_id HAVING count(DISTINCT (ord % 3)) > 1""",
    SAMPLES,
)
def split_leak_audit(spark, d):
    return P.leaks(samples(spark, d).withColumn("split", F.col("ord") % 3), "sample_id")


@query("SELECT text FROM smp WHERE ord % 2 = 0 INTERSECT SELECT text FROM smp WHERE ord % 2 = 1", SAMPLES)
def shared_texts(spark, d):
    t = samples(spark, d)
    return t.where("ord % 2 = 0").select("text").intersect(t.where("ord % 2 = 1").select("text"))


@query("SELECT text FROM smp WHERE ord % 2 = 0 EXCEPT SELECT text FROM smp WHERE ord % 2 = 1", SAMPLES)
def texts_of_one_side(spark, d):
    t = samples(spark, d)
    return t.where("ord % 2 = 0").select("text").subtract(t.where("ord % 2 = 1").select("text"))


@query(
    f"""SELECT ord, sample_type FROM (SELECT *, row_number() OVER (PARTITION BY sample_type ORDER BY {h(42, "ord::VARCHAR")}) AS k, count(*) OVER (PARTITION BY sample_type) AS n FROM smp)
    WHERE k <= greatest(1, floor(n * 0.25::DOUBLE))""",
    SAMPLES,
)
def fraction_sample(spark, d):
    return P.fraction(samples(spark, d), "sample_type", 0.25, P.seeded(42, F.col("ord").cast("string"))).select("ord", "sample_type")


MINI = f"""key AS (SELECT *, CASE WHEN ord % 3 > 0 THEN 'pair::cf:' || (ord // 3) ELSE 'single::' || ord END AS mini_key FROM smp),
mgr AS (
    SELECT mini_key, string_agg(part, ',' ORDER BY part) AS composition, sum(n) AS members, sum(w) AS weight
    FROM (SELECT mini_key, source || '/' || label || '/' || count(*) AS part, count(*) AS n, sum(CASE WHEN label = 1 THEN 0.5::DOUBLE ELSE 0.2::DOUBLE END) AS w FROM key GROUP BY mini_key, source, label) GROUP BY mini_key
), cho AS (
    SELECT mini_key FROM (
        SELECT *, sum(members) OVER (PARTITION BY composition ORDER BY {h(7, "mini_key")} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, sum(weight) OVER (PARTITION BY composition) AS target FROM mgr
    ) WHERE coalesce(before, 0) < greatest(1, round_even(round(target, 9), 0))
), sub AS (SELECT * FROM key WHERE mini_key IN (SELECT mini_key FROM cho))"""


def keyed(spark, d):
    pair = F.when(F.col("ord") % 3 > 0, F.concat(F.lit("cf:"), F.floor(F.col("ord") / 3).cast("string")))
    return samples(spark, d).withColumn("mini_key", P.mini_group(F.lit(None).cast("string"), pair, F.col("ord")))


@query("SELECT ord, mini_key FROM sub", SAMPLES, MINI)
def mini_subset(spark, d):
    return P.mini_subset(keyed(spark, d), 0.5, 0.2, 7).select("ord", "mini_key")


@query(
    """SELECT source, label, coalesce(b.n, 0) AS n_before, coalesce(a.n, 0) AS n_after, CASE WHEN b.n > 0 THEN round(coalesce(a.n, 0) / b.n, 6) END AS ratio
    FROM (SELECT source, label, count(*) AS n FROM smp GROUP BY ALL) b FULL JOIN (SELECT source, label, count(*) AS n FROM sub GROUP BY ALL) a USING (source, label)""",
    SAMPLES, MINI,
)
def distribution_report(spark, d):
    rows = keyed(spark, d)
    return clean.before_after(rows, P.mini_subset(rows, 0.5, 0.2, 7)).withColumn("ratio", F.round("ratio", 6))


@query(
    """, ids AS (SELECT sample_index, row_number() OVER (ORDER BY sample_index) - 1 AS k FROM (SELECT DISTINCT sample_index FROM st WHERE sample_index % 3 <> 1))
    SELECT k AS sample_index, ids.sample_index AS original_index, count(*) AS steps FROM st JOIN ids USING (sample_index) GROUP BY k, ids.sample_index""",
    STEPS,
)
def mini_remap(spark, d):
    s = steps(spark, d)
    kept = P.remap(s.select("sample_index", "step_index"), s.where("sample_index % 3 <> 1").select("sample_index"))
    return kept.groupBy("sample_index", "original_index").agg(F.count(F.lit(1)).alias("steps"))


@query(
    f"""SELECT task_id FROM (SELECT task_id, row_number() OVER (ORDER BY {h(3, "task_id::VARCHAR")}) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT user_id AS task_id FROM events))
    WHERE k <= greatest(1, round_even(n * 0.3::DOUBLE, 0)) ORDER BY task_id LIMIT 20"""
)
def task_sample(spark, d):
    return P.sample_ids(table(spark, d, "events").select(F.col("user_id").alias("task_id")), 0.3, 3, most=20)


@query("SELECT sample_index, step_index FROM st WHERE NOT (event_id % 4 = 0)", STEPS)
def resume_antijoin(spark, d):
    s = steps(spark, d).select("sample_index", "step_index", "event_id")
    return S.resume(s, s.where("event_id % 4 = 0")).select("sample_index", "step_index")


@query(
    """SELECT DISTINCT event_type AS extraction_mode, 'all' AS sink, (SELECT count(DISTINCT event_type) FROM events) > 1 AS refused FROM events
    UNION ALL SELECT DISTINCT event_type, 'own', false FROM events"""
)
def mode_guard(spark, d):
    """Whether a sink is refused that holds all modes' rows, or its own mode's alone."""
    rows = table(spark, d, "events").select(F.col("event_type").alias("extraction_mode"))

    def refused(sink, mode: str) -> bool:
        try:
            S.check_mode(sink, mode)
        except ValueError:
            return True
        return False

    modes = sorted(r[0] for r in rows.distinct().collect())
    out = [(m, name, refused(sink, m)) for m in modes for name, sink in (("all", rows), ("own", rows.where(F.col("extraction_mode") == m)))]
    return spark.createDataFrame(out, "extraction_mode string, sink string, refused boolean")
