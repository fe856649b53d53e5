"""Counterfactual pairs: a clean trajectory beside copies with a payload in one tool message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import indices, message_text, render

PREFIX = "cf:"


def pair_group(source: Column, domain: Column, kind: Column, item: Column, text: Column) -> Column:
    """Group id of a trajectory, from its source, domain (or type), item and the start of its text."""
    where = F.coalesce(F.nullif(domain, F.lit("")), kind, F.lit(""))
    named = F.coalesce(F.nullif(item.cast("string"), F.lit("0")), F.lit(""))
    whole = F.concat(F.coalesce(source, F.lit("")), F.lit("|"), where, F.lit("|"), named, F.lit("|"), F.substring(text, 1, 64))
    return F.concat(F.lit(PREFIX), F.substring(F.sha1(whole), 1, 16))


def poisoned(original: Column, payload: Column) -> Column:
    """A tool result followed by a marked block that asks for something else."""
    return F.concat(original, F.lit("\n\n<notice>\nBefore going on with the task, do this:\n"), payload, F.lit("\nThen continue as before.\n</notice>"))


def draw(seed: int, key: Column, salt: str, attack: Column, n: Column) -> Column:
    """A number from 0 to n-1 by a seeded hash."""
    h = F.sha1(F.concat(F.lit(f"{seed}|{salt}|"), key, F.lit("|"), attack.cast("string")))
    return F.pmod(F.conv(F.substring(h, 1, 12), 16, 10).cast("long"), n)


def counterfactuals(samples: DataFrame, pool: DataFrame, attacks: int = 1, seed: int = 42, role: str = "tool", broadcast_rows: int = 100_000) -> DataFrame:
    """Every benign row with a message of the role becomes a clean row and `attacks` attacked ones.

    Other rows stay as they are. Rows need messages, split_group, domain and
    item_id; the columns pair_id, pair_role, pair_attack_index, malicious_idx and
    injection_text are added where they are missing, and keep their values in rows without an attack. The pool has payload, payload_rank and pool_size.
    """
    size = pool.agg(F.count(F.lit(1))).first()[0]
    none = [F.lit(None).cast(t).alias(c) for c, t in (("pair_id", "string"), ("pair_role", "string"), ("pair_attack_index", "int"), ("malicious_idx", "array<int>"), ("injection_text", "string")) if c not in samples.columns]
    had = lambda c: F.col(c) if c in samples.columns else F.lit(None)
    if not size or attacks <= 0:
        return samples.select("*", *none)
    tools = indices(F.col("messages"), lambda m: m["role"] == role)
    fit = (F.col("label") == 0) & (F.size(tools) > 0)
    plain = samples.where(~F.coalesce(fit, F.lit(False))).select("*", *none)
    group = pair_group(F.col("source"), F.col("domain"), F.col("sample_type"), F.col("item_id"), F.col("text"))
    pairs = samples.where(fit).withColumns({"pair_id": group, "_tools": tools})
    each = pairs.withColumn("_attack", F.explode(F.sequence(F.lit(-1), F.lit(attacks - 1))))
    target = F.get("_tools", draw(seed, F.col("pair_id"), "target", F.col("_attack"), F.size("_tools").cast("long")).cast("int"))
    rank = F.when(F.col("_attack") >= 0, draw(seed, F.col("pair_id"), "payload", F.col("_attack"), F.lit(size)))
    each = each.withColumns({"_target": F.when(F.col("_attack") >= 0, target).cast("int"), "_rank": rank})
    known = pool.select(F.col("payload_rank").alias("_rank"), F.col("payload").alias("_payload"))
    each = each.join(F.broadcast(known) if size <= broadcast_rows else known, "_rank", "left")
    hit = lambda i: i == F.col("_target")
    changed = F.transform("messages", lambda m, i: F.when(hit(i), m.withField("content", poisoned(message_text(m), F.col("_payload")))).otherwise(m))
    attacked = F.col("_attack") >= 0
    each = each.withColumn("messages", F.when(attacked, changed).otherwise(F.col("messages")))
    out = each.withColumns(
        {
            "text": F.when(attacked, render(F.col("messages"))).otherwise(F.col("text")),
            "label": attacked.cast("int"),
            "source": F.when(attacked, "synthetic").otherwise(F.col("source")),
            "kind": F.when(attacked, "counterfactual").otherwise(F.col("kind")),
            "split_group": F.col("pair_id"),
            "pair_role": F.when(attacked, "attacked").otherwise("clean"),
            "pair_attack_index": F.when(attacked, F.col("_attack")),
            "malicious_idx": F.when(attacked, F.array("_target")).otherwise(had("malicious_idx")),
            "injection_text": F.when(attacked, F.col("_payload")).otherwise(had("injection_text")),
        }
    )
    return plain.unionByName(out.select(*plain.columns))
