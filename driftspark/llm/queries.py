"""One query an operator, on its whole table with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bloom_dedup, boosted, chat, crf, jaccard, mixing, packing, ppm, suffix_dedup, wavelet
from .common import load

#: Tempering of the shares of words: sources towards equal parts, languages a little.
SOURCE_POWER, LANG_POWER = 0.7, 0.9


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    counts = mixing.word_counts(docs, ["source", "lang"])
    targets = {"source": mixing.temper(counts, "source", SOURCE_POWER), "lang": mixing.temper(counts, "lang", LANG_POWER)}
    return mixing.mix_to_targets(docs, targets, counts=counts).drop("text")


def op2_best_fit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(load(spark, sf_dir, "documents"))


def op3_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(load(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(load(spark, sf_dir, "conversations"))


def op5_crf_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    field = crf.train(docs, load(spark, sf_dir, "labels"))
    return crf.label_lines(docs.select("doc_id", "text"), field).drop("text")


def op6_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ppm.ppm_score(load(spark, sf_dir, "documents"))
    return scored.withColumns({"bits": F.round("bits", 3), "bits_per_byte": F.round("bits_per_byte", 6)})


def op7_bloom_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_dedup.exact_dedup(load(spark, sf_dir, "documents"))


def op8_rtree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_classes(load(spark, sf_dir, "documents"))


def op9_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.token_shards(load(spark, sf_dir, "documents"))


def op10_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = boosted.train(docs, load(spark, sf_dir, "labels"))
    return boosted.classify(docs.select("doc_id", "text"), model).drop("text")


QUERIES = {
    f.__name__: f
    for f in (op1_mix_sources, op2_best_fit_pack, op3_suffix_repeats, op4_chat_format, op5_crf_rules, op6_ppm_score, op7_bloom_dedup, op8_rtree_join, op9_wavelet_shards, op10_boosted_quality)
}

ORACLES = {
    "op3_suffix_repeats": """
        WITH w AS (
            SELECT DISTINCT doc_id, text, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x20]+') AS w
            FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL
        ), p AS (
            SELECT doc_id, i - 1 AS pos, array_to_string(w[i:i + 49], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50)
        ), f AS (
            SELECT doc_id, pos, count(*) OVER (PARTITION BY g) AS n, first_value(doc_id) OVER o AS first_doc, row_number() OVER o > 1 AS remove
            FROM p WINDOW o AS (PARTITION BY g ORDER BY doc_id, pos)
        ), s AS (
            SELECT *, coalesce(pos - lag(pos) OVER (PARTITION BY doc_id, first_doc, remove ORDER BY pos) > 50, true)::INT AS new FROM f WHERE n > 1
        ), i AS (
            SELECT *, sum(new) OVER (PARTITION BY doc_id, first_doc, remove ORDER BY pos) AS island FROM s
        )
        SELECT doc_id, min(pos) AS start, max(pos) + 50 AS stop, max(pos) + 50 - min(pos) AS n_words, first_doc, remove
        FROM i GROUP BY doc_id, first_doc, remove, island""",
    "op4_chat_format": """
        WITH m AS (
            SELECT conv_id, coalesce(role, 'user') AS r, coalesce(text, '') AS c,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k
            FROM conversations
        ), p AS (
            SELECT *, '<|im_start|>' || r || chr(10) AS head, c || '<|im_end|>' AS body FROM m
        ), q AS (
            SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS s FROM p
        )
        SELECT conv_id, count(*) AS n_turns, string_agg(head || body || chr(10), '' ORDER BY k) AS text,
               coalesce(string_agg(s::BIGINT || '-' || (s + length(body))::BIGINT, ',' ORDER BY k) FILTER (WHERE r = 'assistant'), '') AS spans,
               CAST(NULL AS VARCHAR) AS error
        FROM q GROUP BY conv_id""",
    # Contexts and bytes are hex digits, two a byte. Level k has the contexts of k bytes; e is what an escape from it costs.
    "op6_ppm_score": """
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, ascii(md5(coalesce(text, ''))) % 2 AS fold, '000000' || hex(encode(coalesce(text, ''))) AS h FROM documents
        ), rg AS (
            SELECT r, fold, substring(h, 2 * i + 1, 8) AS g, count(*) AS n FROM (SELECT r, fold, h, unnest(range(0, (length(h) - 6) // 2)) AS i FROM d) GROUP BY ALL
        ), n3 AS (
            SELECT f, g, substring(g, 1, 6) AS c, substring(g, 3) AS g2, sum(CASE WHEN fold = f THEN n ELSE 0 END)::DOUBLE AS n FROM rg, (SELECT unnest([0, 1]) AS f) GROUP BY f, g
        ), n2 AS (SELECT f, g2 AS g, substring(g2, 1, 4) AS c, substring(g2, 3) AS g1, sum(n) AS n FROM n3 GROUP BY f, g2),
        n1 AS (SELECT f, g1 AS g, substring(g1, 1, 2) AS c, substring(g1, 3) AS g0, sum(n) AS n FROM n2 GROUP BY f, g1),
        n0 AS (SELECT f, g0 AS g, sum(n) AS n FROM n1 GROUP BY f, g0),
        t3 AS (SELECT a.f, a.c, sum(a.n) AS t, count(*) FILTER (WHERE a.n > 0) AS d, coalesce(sum(b.n) FILTER (WHERE a.n > 0), 0) AS x FROM n3 a JOIN n2 b ON b.f = a.f AND b.g = a.g2 GROUP BY a.f, a.c),
        t2 AS (SELECT a.f, a.c, sum(a.n) AS t, count(*) FILTER (WHERE a.n > 0) AS d, coalesce(sum(b.n) FILTER (WHERE a.n > 0), 0) AS x FROM n2 a JOIN n1 b ON b.f = a.f AND b.g = a.g1 GROUP BY a.f, a.c),
        t1 AS (SELECT a.f, a.c, sum(a.n) AS t, count(*) FILTER (WHERE a.n > 0) AS d, coalesce(sum(b.n) FILTER (WHERE a.n > 0), 0) AS x FROM n1 a JOIN n0 b ON b.f = a.f AND b.g = a.g0 GROUP BY a.f, a.c),
        t0 AS (SELECT f, sum(n) AS t, count(*) FILTER (WHERE n > 0) AS d FROM n0 GROUP BY f),
        lv AS (
            SELECT a.f, a.g, a.n AS m3, b.n AS m2, c.n AS m1, e.n AS m0, t3.t AS s3, t3.d AS k3, t2.t - t3.x AS s2, t2.d - t3.d AS k2, t1.t - t2.x AS s1, t1.d - t2.d AS k1, t0.t - t1.x AS s0, t0.d - t1.d AS k0, t0.d AS all_
            FROM n3 a JOIN n2 b ON b.f = a.f AND b.g = a.g2 JOIN n1 c ON c.f = a.f AND c.g = b.g1 JOIN n0 e ON e.f = a.f AND e.g = c.g0
            JOIN t3 ON t3.f = a.f AND t3.c = a.c JOIN t2 ON t2.f = a.f AND t2.c = b.c JOIN t1 ON t1.f = a.f AND t1.c = c.c JOIN t0 ON t0.f = a.f
        ), es AS (
            SELECT *, CASE WHEN k3 > 0 THEN -log2(k3 / (s3 + k3)) ELSE 0 END AS e3, CASE WHEN k2 > 0 THEN -log2(k2 / (s2 + k2)) ELSE 0 END AS e2,
                CASE WHEN k1 > 0 THEN -log2(k1 / (s1 + k1)) ELSE 0 END AS e1, CASE WHEN k0 > 0 THEN -log2(k0 / (s0 + k0)) ELSE 0 END AS e0 FROM lv
        ), cost AS (
            SELECT f, g, (CASE WHEN m3 > 0 THEN -log2(m3 / (s3 + k3)) WHEN m2 > 0 THEN e3 - log2(m2 / (s2 + k2)) WHEN m1 > 0 THEN e3 + e2 - log2(m1 / (s1 + k1))
                WHEN m0 > 0 THEN e3 + e2 + e1 - log2(m0 / (s0 + k0)) ELSE e3 + e2 + e1 + e0 + log2(256 - all_) END)::FLOAT::DOUBLE AS cost FROM es
        ), sm AS (SELECT r, sum(n * cost) AS bits FROM rg JOIN cost ON cost.g = rg.g AND cost.f = 1 - rg.fold GROUP BY r)
        SELECT doc_id, (length(h) - 6) // 2 AS n_bytes, round(coalesce(bits, 0), 3) AS bits, CASE WHEN length(h) > 6 THEN round(bits / ((length(h) - 6) // 2), 6) END AS bits_per_byte
        FROM d LEFT JOIN sm USING (r)""",
    "op7_bloom_dedup": """
        SELECT doc_id, text, lang, source, n_chars FROM (
            SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS LAST) AS k FROM documents
        ) WHERE k = 1 OR text IS NULL""",
    "op8_rtree_join": """
        WITH RECURSIVE w AS (
            SELECT DISTINCT doc_id, text, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x20]+') AS w
            FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL
        ), g AS (
            SELECT doc_id, text, unnest(list_distinct(
                CASE WHEN len(w) >= 3 THEN [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]
                     WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s
            FROM w
        ), n AS (SELECT doc_id, text, count(*) AS n FROM g GROUP BY ALL),
        c AS (
            SELECT a.doc_id AS x, a.text AS tx, b.doc_id AS y, b.text AS ty, count(*) AS c
            FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
        )
        , p AS (
            SELECT DISTINCT x, y FROM c JOIN n p ON p.doc_id = x AND p.text = tx JOIN n q ON q.doc_id = y AND q.text = ty WHERE c / (p.n + q.n - c)::DOUBLE >= 0.5
        ), b AS MATERIALIZED (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
        r AS (SELECT x, y FROM b UNION SELECT r.x, b.y FROM r JOIN b ON b.x = r.y),
        root AS (SELECT x, min(y) AS y FROM r GROUP BY x), k AS (SELECT x, count(*) AS k FROM b GROUP BY x)
        SELECT doc_id, coalesce(least(doc_id, root.y), doc_id) AS class_id, coalesce(k, 0) AS n_links
        FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) LEFT JOIN root ON root.x = doc_id LEFT JOIN k ON k.x = doc_id""",
}
