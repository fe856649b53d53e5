"""Tool steps of trajectories, with labels that spread forward from the first injection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import indices, locator, message_text, normalize, task_prefix, task_text, tool_name

MODE = "task_anchor_v1"


def step_label(label: Column, at: Column, first: Column) -> Column:
    """1 from the first injected message on, 0 before; -1 for positives that nothing locates."""
    return F.when((label == 1) & first.isNotNull(), (at >= first).cast("int")).when(label == 1, F.lit(-1)).otherwise(label)


def label_source(label: Column, first: Column) -> Column:
    return F.when((label == 1) & first.isNotNull(), "matched_injection").when(label == 1, "unlocatable").otherwise("trajectory")


def tool_steps(samples: DataFrame, role: str = "tool", mode: str = MODE) -> DataFrame:
    """One row a tool message, in order.

    samples has sample_index, label, messages and, for locating, malicious_idx,
    injection_fragments and injection_text (any may be null). Prefixes are not
    copied: a step's history is the first tool_message_index messages, its post
    state one more; see prefixes().
    """
    work = samples.withColumn("messages", normalize(F.col("messages")))
    first = F.when(F.col("label") == 1, F.array_min(locator(F.col("malicious_idx"), F.col("injection_fragments"), F.col("injection_text"), F.col("messages"), role)))
    work = work.withColumns({"_first": first, "_at": indices(F.col("messages"), lambda m: m["role"] == role)})
    rows = work.select("*", F.posexplode("_at").alias("step_index", "tool_message_index"))
    fields = samples.schema["messages"].dataType.elementType.names
    here = F.get("messages", F.col("tool_message_index"))
    call = here["tool_call"] if "tool_call" in fields else F.lit(None).cast("variant")
    name = here["name"] if "name" in fields else F.lit(None).cast("string")
    return rows.withColumns(
        {
            "trajectory_label": F.col("label"),
            "label": step_label(F.col("label"), F.col("tool_message_index"), F.col("_first")),
            "step_label_source": label_source(F.col("label"), F.col("_first")),
            "task_text": task_text(F.col("messages")),
            "tool_name": tool_name(call, name),
            "extraction_mode": F.lit(mode),
        }
    ).drop("_first", "_at")


def prefixes(steps: DataFrame) -> DataFrame:
    """steps with the three message prefixes that a step is encoded by."""
    at = F.col("tool_message_index")
    return steps.withColumns({"task_prefix": task_prefix(F.col("messages")), "history_prefix": F.slice("messages", F.lit(1), at), "post_prefix": F.slice("messages", F.lit(1), at + 1)})


def resume(steps: DataFrame, done: DataFrame) -> DataFrame:
    """Steps that the sink does not have yet."""
    return steps.join(done.select("sample_index", "step_index"), ["sample_index", "step_index"], "left_anti")


def check_mode(done: DataFrame, mode: str = MODE) -> None:
    """Raises if the sink holds rows that were made another way."""
    other = done.where(~F.col("extraction_mode").eqNullSafe(F.lit(mode))).select("extraction_mode").limit(1).collect()
    if other:
        raise ValueError(f"the sink holds rows of mode {other[0][0]!r}, not {mode!r}")


def char_cut(messages: Column, budget: int) -> Column:
    """Contents cut to a budget of characters each."""
    return F.transform(messages, lambda m: m.withField("content", F.substring(message_text(m), 1, max(0, budget))))
