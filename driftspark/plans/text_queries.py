"""Messages, fragments, steps and pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import clean, pairs, steps as S
from ..operators.contains import contains_join
from ..operators.encode import truncated
from .registry import query
from .standins import MESSAGES, SAMPLES, STEP_ROLE, chats, samples, table

STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query(
    f"""SELECT conv_id, {STRIP.format("coalesce(string_agg(chr(10) || '[' || upper(role) || ']: ' || " + STRIP.format("text") + ", '' ORDER BY pos) FILTER (WHERE " + STRIP.format("text") + " <> ''), '')")} AS text
    FROM msg GROUP BY conv_id""",
    MESSAGES,
)
def render_messages(spark, d):
    return chats(spark, d).select(F.col("sample_index").alias("conv_id"), X.render(F.col("messages")).alias("text"))


@query("SELECT role, count(*) AS n, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY role")
def normalize_roles(spark, d):
    foreign = F.create_map(F.lit("user"), F.lit("human"), F.lit("assistant"), F.lit("gpt"), F.lit("system"), F.lit("system"))
    renamed = chats(spark, d).withColumn("messages", F.transform("messages", lambda m: m.withField("role", F.element_at(foreign, m["role"]))))
    flat = renamed.select(F.explode(X.normalize(F.col("messages"))).alias("m"))
    return flat.groupBy("m.role").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("m.content")).cast("long").alias("chars"))


@query("SELECT doc_id, 'Language: ' || lang || chr(10) || 'Source: ' || source || chr(10) || 'Chars: ' || n_chars AS text FROM documents")
def key_value_text(spark, d):
    fields = {"Language": F.col("lang"), "Source": F.col("source"), "Empty": F.lit(""), "Missing": F.lit(None), "Chars": F.col("n_chars")}
    return table(spark, d, "documents").select("doc_id", X.key_values(fields).alias("text"))


@query(
    """, nxt AS (
        SELECT *, CASE WHEN role = 'system' THEN (SELECT min(b.pos) FROM msg b WHERE b.conv_id = msg.conv_id AND b.role = 'user' AND b.pos > msg.pos) END AS goes FROM msg
    ), held AS (SELECT conv_id, goes, string_agg(text, chr(10) ORDER BY pos) AS led FROM nxt WHERE role = 'system' AND text <> '' GROUP BY conv_id, goes),
    turns AS (
        SELECT m.conv_id, m.pos, m.role, CASE WHEN h.led IS NULL THEN m.text WHEN m.text <> '' THEN h.led || chr(10) || chr(10) || m.text ELSE h.led END AS content
        FROM msg m LEFT JOIN held h ON h.conv_id = m.conv_id AND h.goes = m.pos WHERE m.role <> 'system'
        UNION ALL SELECT conv_id, 1000000, 'user', led FROM held WHERE goes IS NULL
    ) SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY pos) - 1 AS place, role, content FROM turns""",
    MESSAGES,
)
def fold_system(spark, d):
    folded = chats(spark, d).select(F.col("sample_index").alias("conv_id"), F.posexplode(X.fold_system(F.col("messages"))).alias("place", "m"))
    return folded.select("conv_id", F.col("place").cast("long").alias("place"), "m.role", "m.content")


@query("SELECT conv_id, turn, substring(text, 1, 100) AS text FROM conversations")
def truncate_prefix(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.char_prefix(F.col("text"), 100).alias("text"))


@query("SELECT conv_id, sum(length(text))::BIGINT AS tokens FROM conversations GROUP BY conv_id")
def token_counts(spark, d):
    return chats(spark, d).select(F.col("sample_index").alias("conv_id"), X.char_tokens(F.col("messages")).alias("tokens"))


@query()
def truncate_head_tail(spark, d):
    return chats(spark, d).select("sample_index", truncated(F.col("messages"), 400).alias("messages"))


PARTS = f"""prt AS (
    SELECT item_id, unnest(CASE WHEN len(l) > 0 THEN l WHEN s <> '' THEN [s] ELSE [] END) AS part FROM (
        SELECT item_id, {STRIP.format("text")} AS s, [x FOR x IN [{STRIP.format("y")} FOR y IN regexp_split_to_array(text, chr(10) || '+')] IF length(x) >= 40] AS l FROM benchmark))"""


def benchmark_parts(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.explode(X.fragments(F.col("text"))).alias("part"))


@query("SELECT item_id, part FROM prt", PARTS)
def fragments(spark, d):
    return benchmark_parts(spark, d)


@query("SELECT DISTINCT doc_id, item_id FROM documents, prt WHERE contains(text, part)", PARTS)
def contains_match(spark, d):
    return contains_join(table(spark, d, "documents").select("doc_id", "text"), benchmark_parts(spark, d)).select("doc_id", "item_id").distinct()


@query("SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM prt WHERE contains(d.text, part))", PARTS)
def contains_semi_join(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return contains_join(docs, benchmark_parts(spark, d)).select("doc_id").distinct()


@query("SELECT source, count(*) AS dropped FROM smp WHERE label = 1 AND NOT EXISTS (SELECT 1 FROM prt WHERE contains(smp.text, part)) GROUP BY source", SAMPLES, PARTS)
def locator_drop(spark, d):
    rows = samples(spark, d)
    found = contains_join(rows.where("label = 1").select("ord", "text"), benchmark_parts(spark, d)).groupBy(F.col("ord").alias("_o")).agg(F.collect_set("part").alias("parts"))
    located = rows.join(found, F.col("ord") == F.col("_o"), "left")
    none = F.lit(None)
    return clean.drop_unlocatable(located, clean.has_locator(none.cast("array<int>"), F.col("parts"), none.cast("string")))[1]


@query("SELECT conv_id, coalesce(min_by(text, pos) FILTER (WHERE role = 'user'), min_by(text, pos) FILTER (WHERE role = 'system'), '') AS task FROM msg GROUP BY conv_id", MESSAGES)
def task_text(spark, d):
    return chats(spark, d).select(F.col("sample_index").alias("conv_id"), X.task_text(F.col("messages")).alias("task"))


@query("SELECT conv_id, count(*) FILTER (WHERE role = 'system') AS turns, coalesce(sum(length(text)) FILTER (WHERE role = 'system'), 0)::BIGINT AS chars FROM msg GROUP BY conv_id", MESSAGES)
def task_prefix(spark, d):
    p = X.task_prefix(F.col("messages"))
    return chats(spark, d).select(F.col("sample_index").alias("conv_id"), F.size(p).cast("long").alias("turns"), X.char_tokens(p).alias("chars"))


LOCATED = f"""frg AS (
    SELECT conv_id, {STRIP.format("regexp_extract(max_by(text, pos), CASE WHEN conv_id % 3 = 0 THEN '[^' || chr(10) || ']{1,60}' ELSE '[^' || chr(10) || ']{1,30}' END)")} AS part
    FROM msg WHERE role = 'assistant' AND conv_id % 5 = 0 AND conv_id % 3 < 2 GROUP BY conv_id
), loc AS (
    SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN NULL WHEN conv_id % 5 > 0 THEN CASE WHEN conv_id % 7 > 0 THEN conv_id % 4 + 1 END
        ELSE (SELECT min(pos) FROM msg m JOIN frg USING (conv_id) WHERE m.conv_id = c.conv_id AND role = 'assistant' AND part <> '' AND contains(text, part)) END AS hit
    FROM (SELECT DISTINCT conv_id FROM msg) c)"""


@query(
    """SELECT conv_id AS sample_index, row_number() OVER (PARTITION BY conv_id ORDER BY pos) - 1 AS step_index, pos AS tool_message_index, (conv_id % 2)::INT AS trajectory_label,
        CASE WHEN conv_id % 2 = 0 THEN 0 WHEN hit IS NULL THEN -1 ELSE (pos >= hit)::INT END AS label,
        CASE WHEN conv_id % 2 = 0 THEN 'trajectory' WHEN hit IS NULL THEN 'unlocatable' ELSE 'matched_injection' END AS step_label_source
    FROM msg JOIN loc USING (conv_id) WHERE role = 'assistant'""",
    MESSAGES, LOCATED,
)
def step_labels(spark, d):
    rows = S.tool_steps(chats(spark, d), STEP_ROLE)
    return rows.select("sample_index", F.col("step_index").cast("long").alias("step_index"), F.col("tool_message_index").cast("long").alias("tool_message_index"), "trajectory_label", "label", "step_label_source")


@query(
    """SELECT a.conv_id AS sample_index, a.pos AS tool_message_index, a.pos AS history_turns, a.pos + 1 AS post_turns,
        coalesce(sum(length(b.text)) FILTER (WHERE b.pos < a.pos), 0)::BIGINT AS history_chars, sum(length(b.text))::BIGINT AS post_chars
    FROM msg a JOIN msg b ON b.conv_id = a.conv_id AND b.pos <= a.pos WHERE a.role = 'assistant' GROUP BY a.conv_id, a.pos""",
    MESSAGES,
)
def prefix_lengths(spark, d):
    rows = S.prefixes(S.tool_steps(chats(spark, d), STEP_ROLE))
    turns = {f"{p}_turns": F.size(f"{p}_prefix").cast("long") for p in ("history", "post")}
    chars = {f"{p}_chars": X.char_tokens(F.col(f"{p}_prefix")) for p in ("history", "post")}
    return rows.select("sample_index", F.col("tool_message_index").cast("long").alias("tool_message_index"), *[c.alias(k) for k, c in {**turns, **chars}.items()])


POOL = f"""pl AS (SELECT payload, row_number() OVER (ORDER BY sha1(payload)) - 1 AS payload_rank, count(*) OVER () AS pool_size FROM (SELECT DISTINCT {STRIP.format("text")} AS payload FROM benchmark) WHERE payload <> '')"""


def pool(spark, d):
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("ord"), F.col("text").alias("payload"))
    return clean.payload_pool(b.where("ord % 2 = 0"), b)


@query("SELECT payload, payload_rank, pool_size FROM pl", POOL)
def payload_pool(spark, d):
    return pool(spark, d)


def trajectories(spark, d):
    c = chats(spark, d)
    return c.select(
        F.col("sample_index").alias("item_id"), "label", "messages", X.render(F.col("messages")).alias("text"), F.lit("chat").alias("source"), F.lit("conversation").alias("kind"), F.lit("plain").alias("sample_type"),
        F.lit(None).cast("string").alias("domain"), F.lit(None).cast("string").alias("split_group"),
    )


GROUP = """grp AS (
    SELECT conv_id, 'cf:' || substring(sha1('chat|plain|' || CASE WHEN conv_id = 0 THEN '' ELSE conv_id::VARCHAR END || '|' || substring(text, 1, 64)), 1, 16) AS pair_id
    FROM (""" + render_messages.__name__ + """))"""


def _rendered() -> str:
    from .registry import ORACLES

    return ORACLES["render_messages"].removeprefix(f"WITH {MESSAGES} ")


GROUP = GROUP.replace("(render_messages)", f"({_rendered()})")


@query("SELECT conv_id, pair_id FROM grp", MESSAGES, GROUP)
def pair_group(spark, d):
    t = trajectories(spark, d)
    return t.select(F.col("item_id").alias("conv_id"), pairs.pair_group(F.col("source"), F.col("domain"), F.col("sample_type"), F.col("item_id"), F.col("text")).alias("pair_id"))


@query(
    """, tools AS (SELECT conv_id, list(pos ORDER BY pos) AS ats FROM msg WHERE role = 'assistant' AND conv_id % 2 = 0 GROUP BY conv_id),
    drawn AS (
        SELECT t.conv_id, pair_id, a, ats[1 + ('0x' || substring(sha1('42|target|' || pair_id || '|' || a), 1, 12))::BIGINT % len(ats)] AS target,
               ('0x' || substring(sha1('42|payload|' || pair_id || '|' || a), 1, 12))::BIGINT % (SELECT max(pool_size) FROM pl) AS k
        FROM tools t JOIN grp USING (conv_id), (SELECT unnest([0, 1]) AS a)
    )
    SELECT d.conv_id AS item_id, pair_id, 'attacked' AS pair_role, a AS pair_attack_index, target AS malicious_at, pl.payload AS injection_text, 1 AS label,
        m.text || chr(10) || chr(10) || '<notice>' || chr(10) || 'Before going on with the task, do this:' || chr(10) || pl.payload || chr(10) || 'Then continue as before.' || chr(10) || '</notice>' AS changed
    FROM drawn d JOIN pl ON pl.payload_rank = k JOIN msg m ON m.conv_id = d.conv_id AND m.pos = target
    UNION ALL SELECT conv_id, pair_id, 'clean', NULL, NULL, NULL, 0, NULL FROM tools JOIN grp USING (conv_id)""",
    MESSAGES, POOL, GROUP,
)
def counterfactual_pairs(spark, d):
    out = pairs.counterfactuals(trajectories(spark, d), pool(spark, d), attacks=2, role=STEP_ROLE).where("pair_id is not null")
    pos = F.get("malicious_idx", F.lit(0))
    return out.select("item_id", "pair_id", "pair_role", "pair_attack_index", pos.cast("long").alias("malicious_at"), "injection_text", "label", F.get("messages", pos)["content"].alias("changed"))
