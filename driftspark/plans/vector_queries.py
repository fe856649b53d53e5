"""Tensor algebra, anchors and causal baselines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import features as X
from .registry import query
from .standins import ACTS, acts

KEYS = ["sample_index", "step_index"]
NORMS = ("inc_norm", "glob_norm", "hist_norm", "rel_norm")


def drift(spark, d):
    return X.drift(acts(spark, d))


@query(
    """SELECT sample_index, step_index, round(list_sum(flatten(inc)), 6) AS inc_sum, round(list_sum(flatten("glob")), 6) AS glob_sum, round(list_sum(flatten(prog)), 6) AS prog_sum
    FROM (SELECT sample_index, step_index, list(inc ORDER BY layer) AS inc, list("glob" ORDER BY layer) AS "glob", list(prog ORDER BY layer) AS prog FROM lay GROUP BY sample_index, step_index)""",
    ACTS,
)
def drift_diffs(spark, d):
    total = lambda c: F.round(F.aggregate(F.flatten(c), F.lit(0.0), lambda s, v: s + v), 6).alias(f"{c}_sum")
    return drift(spark, d).select(*KEYS, total("inc"), total("glob"), total("prog"))


@query("SELECT sample_index, step_index, layer, round(inc_norm, 6) AS inc_norm, round(glob_norm, 6) AS glob_norm, round(hist_norm, 6) AS hist_norm FROM nrm", ACTS)
def layer_norms(spark, d):
    rows = drift(spark, d).select(*KEYS, F.posexplode(F.arrays_zip("inc_norm", "glob_norm", "hist_norm")).alias("layer", "z"))
    return rows.select(*KEYS, F.col("layer").cast("long").alias("layer"), *[F.round(f"z.{c}", 6).alias(c) for c in ("inc_norm", "glob_norm", "hist_norm")])


@query("SELECT sample_index, step_index, layer, round(rel_norm, 6) AS rel_norm FROM rel", ACTS)
def relative_norm(spark, d):
    rows = drift(spark, d).select(*KEYS, F.posexplode("rel_norm").alias("layer", "v"))
    return rows.select(*KEYS, F.col("layer").cast("long").alias("layer"), F.round("v", 6).alias("rel_norm"))


@query("SELECT sample_index, step_index, layer, round(cosine, 6) AS cosine FROM rel", ACTS)
def layer_cosine(spark, d):
    rows = drift(spark, d).select(*KEYS, F.posexplode("cosine").alias("layer", "v"))
    return rows.select(*KEYS, F.col("layer").cast("long").alias("layer"), F.round("v", 6).alias("cosine"))


@query(
    """SELECT sample_index, step_index, 64 AS whole_size, 16 AS last_size, round(list_sum([c[i]::DOUBLE * i FOR i IN range(1, 65)]), 5) AS whole_sum, round(list_sum([c[48 + i]::DOUBLE * i FOR i IN range(1, 17)]), 5) AS last_sum
    FROM vec WHERE step_index >= 2""",
    ACTS,
)
def flatten_modes(spark, d):
    out = []
    for name, mode in (("whole", "concat"), ("last", "last_only")):
        v = F.flatten(V.layers(V.doubles(F.col("post")), mode))
        weighted = F.aggregate(F.transform(v, lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
        out += [F.size(v).alias(f"{name}_size"), F.round(weighted, 5).alias(f"{name}_sum")]
    return acts(spark, d).select(*KEYS, *out)


N_ANCHORS = 20
ORDER = "sha1('42|' || sample_index || '|' || step_index)"


def order():
    return F.sha1(F.concat(F.lit("42|"), F.col("sample_index").cast("string"), F.lit("|"), F.col("step_index").cast("string")))


ANCHORS = f"""anc AS (SELECT sample_index AS ai, step_index AS si, c AS anchor FROM vec WHERE step_index >= 2 AND label = 0 ORDER BY {ORDER} LIMIT {N_ANCHORS})"""


def flat(c: str):
    return F.flatten(V.doubles(F.col(c)))


@query(
    """SELECT row_number() OVER (ORDER BY sha1('42|' || ai || '|' || si)) - 1 AS place, round(list_sum([anchor[i]::DOUBLE * i FOR i IN range(1, 65)]), 5) AS total FROM anc""",
    ACTS, ANCHORS,
)
def anchor_select(spark, d):
    table = X.anchor_table(acts(spark, d), flat("post"), N_ANCHORS, order())
    total = F.aggregate(F.transform("v", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return table.select(F.posexplode("anchors").alias("place", "v")).select(F.col("place").cast("long").alias("place"), F.round(total, 5).alias("total"))


@query(
    """SELECT sample_index, step_index, round(avg(x), 5) AS mean, round(min(x), 5) AS least, round(max(x), 5) AS most, round(stddev_samp(x), 5) AS deviation
    FROM (SELECT sample_index, step_index, sqrt(list_sum([(c[i]::DOUBLE - anchor[i]::DOUBLE) ** 2 FOR i IN range(1, 65)])) AS x FROM vec, anc WHERE step_index >= 2) GROUP BY sample_index, step_index""",
    ACTS, ANCHORS,
)
def anchor_distance(spark, d):
    rows = acts(spark, d)
    out = X.anchor_distances(rows.select(*KEYS, flat("post").alias("v")), F.col("v"), X.anchor_table(rows, flat("post"), N_ANCHORS, order()), "a")
    return out.select(*KEYS, *[F.round(F.get("a", F.lit(i)), 5).alias(n) for i, n in enumerate(("mean", "least", "most", "deviation"))])


@query(
    """, ctr AS (SELECT i, avg(anchor[i]::DOUBLE) AS m FROM anc, (SELECT unnest(range(1, 65)) AS i) GROUP BY i)
    SELECT sample_index, step_index, i - 1 AS dim, round(c[i]::DOUBLE - m, 6) AS diff FROM vec, ctr WHERE step_index >= 2""",
    ACTS, ANCHORS,
)
def anchor_diff(spark, d):
    rows = acts(spark, d)
    out = X.anchor_differences(rows.select(*KEYS, flat("post").alias("v")), F.col("v"), X.anchor_table(rows, flat("post"), N_ANCHORS, order()), "a")
    return out.select(*KEYS, F.posexplode("a").alias("dim", "x")).select(*KEYS, F.col("dim").cast("long").alias("dim"), F.round("x", 6).alias("diff"))


@query("SELECT sample_index, step_index, round(avg(inc_norm), 6) AS inc_mean, round(avg(glob_norm), 6) AS glob_mean FROM nrm GROUP BY sample_index, step_index", ACTS)
def minimal_norm(spark, d):
    return X.minimal_norms(drift(spark, d)).select(*KEYS, F.round("inc_mean", 6).alias("inc_mean"), F.round("glob_mean", 6).alias("glob_mean"))


LONG = "lng AS (" + " UNION ALL ".join(f"SELECT sample_index, step_index, label, layer, '{n}' AS norm, {n} AS v FROM rel" for n in NORMS) + ")"


@query("SELECT norm, layer, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS deviation FROM lng WHERE label = 0 GROUP BY norm, layer HAVING count(*) >= 2", ACTS, LONG)
def benign_baseline(spark, d):
    return X.benign_baseline(drift(spark, d)).select("norm", F.col("layer").cast("long").alias("layer"), F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"))


def z_scores(spark, d, use_baseline: bool):
    rows = drift(spark, d)
    base: dict = {}
    if use_baseline:
        for r in X.benign_baseline(rows).collect():
            base.setdefault(r["norm"], {})[r["layer"]] = (r["mean"], r["deviation"])
    for n in NORMS:
        rows = X.self_baseline(rows, n, 4, baseline=base.get(n))
    named = F.array(*[F.struct(F.lit(n).alias("norm"), F.col(f"{n}_z").alias("z")) for n in NORMS])
    each = rows.select(*KEYS, F.explode(named).alias("s")).select(*KEYS, "s.norm", F.posexplode("s.z").alias("layer", "z"))
    return each.select(*KEYS, "norm", F.col("layer").cast("long").alias("layer"), F.round("z", 4).alias("z"))


Z = """SELECT sample_index, step_index, norm, layer, round(CASE WHEN n >= 2 THEN (v - m) / (s + 1e-6) ELSE {other} END, 4) AS z
    FROM (SELECT *, count(*) OVER w AS n, avg(v) OVER w AS m, stddev_pop(v) OVER w AS s FROM lng
          WINDOW w AS (PARTITION BY sample_index, norm, layer ORDER BY step_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) z"""


@query(Z.format(other="0.0::DOUBLE"), ACTS, LONG)
def self_baseline_zero(spark, d):
    return z_scores(spark, d, False)


@query(Z.format(other="(SELECT (z.v - avg(b.v)) / (stddev_pop(b.v) + 1e-6) FROM lng b WHERE b.label = 0 AND b.norm = z.norm AND b.layer = z.layer)"), ACTS, LONG)
def self_baseline_global(spark, d):
    return z_scores(spark, d, True)


#: Every place of the whole vector: changes, norms, cosines, distances to anchors, z-scores.
FEATURES = f"""fa AS (
    SELECT [c[i]::DOUBLE - b[i]::DOUBLE FOR i IN range(1, 65)] AS ai, [c[i]::DOUBLE - a[i]::DOUBLE FOR i IN range(1, 65)] AS ag
    FROM vec WHERE step_index >= 2 AND label = 0 ORDER BY {ORDER} LIMIT {N_ANCHORS}
), fl AS (
    SELECT sample_index, step_index, [c[i]::DOUBLE - b[i]::DOUBLE FOR i IN range(1, 65)] AS fi, [c[i]::DOUBLE - a[i]::DOUBLE FOR i IN range(1, 65)] AS fg FROM vec WHERE step_index >= 2
), ds AS (
    SELECT sample_index, step_index, w, [avg(x), min(x), max(x), stddev_samp(x)] AS l FROM (
        SELECT sample_index, step_index, 0 AS w, sqrt(list_sum([(fi[i] - ai[i]) ** 2 FOR i IN range(1, 65)])) AS x FROM fl, fa
        UNION ALL SELECT sample_index, step_index, 1, sqrt(list_sum([(fg[i] - ag[i]) ** 2 FOR i IN range(1, 65)])) FROM fl, fa)
    GROUP BY sample_index, step_index, w
), zs AS (
    SELECT sample_index, step_index, norm, layer, CASE WHEN n >= 2 THEN (v - m) / (s + 1e-6) ELSE (v - bm) / (bs + 1e-6) END AS z
    FROM (SELECT *, count(*) OVER w AS n, avg(v) OVER w AS m, stddev_pop(v) OVER w AS s FROM lng
          WINDOW w AS (PARTITION BY sample_index, norm, layer ORDER BY step_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    JOIN (SELECT norm, layer, avg(v) AS bm, stddev_pop(v) AS bs FROM lng WHERE label = 0 GROUP BY norm, layer) USING (norm, layer)
), places AS (
    SELECT sample_index, step_index, layer * 16 + i - 1 AS place, inc[i] AS v FROM rel, (SELECT unnest(range(1, 17)) AS i)
    UNION ALL SELECT sample_index, step_index, 64 + layer * 16 + i - 1, "glob"[i] FROM rel, (SELECT unnest(range(1, 17)) AS i)
    UNION ALL SELECT sample_index, step_index, 128 + 4 * k + layer, [inc_norm, glob_norm, hist_norm, rel_norm, cosine][k + 1] FROM rel, (SELECT unnest(range(0, 5)) AS k)
    UNION ALL SELECT sample_index, step_index, 148 + 4 * w + k, l[k + 1] FROM ds, (SELECT unnest(range(0, 4)) AS k)
    UNION ALL SELECT sample_index, step_index, 156 + 4 * (list_position({list(NORMS)}, norm) - 1) + layer, z FROM zs)"""


@query("SELECT sample_index, step_index, place::BIGINT AS place, CASE WHEN round(v, 4) = 0 THEN 0.0::DOUBLE ELSE round(v, 4) END AS v FROM places", ACTS, LONG, FEATURES)
def feature_matrix(spark, d):
    rows = acts(spark, d)
    changes = X.drift(rows)
    anchored = {c: X.anchors(changes, F.flatten(c), N_ANCHORS, order()) for c in ("inc", "glob")}
    out = X.featurize(rows, X.FeatureConfig(), 4, anchored, X.collected_baseline(changes))
    return out.select(*KEYS, F.posexplode("features").alias("place", "v")).select(*KEYS, F.col("place").cast("long").alias("place"), F.when(F.round("v", 4) == 0, 0.0).otherwise(F.round("v", 4)).alias("v"))
