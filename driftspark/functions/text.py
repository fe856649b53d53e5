"""Column expressions over trajectories: messages are ARRAY<STRUCT<role, content, ...>>."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

#: Names of roles in other conventions.
ROLE_ALIASES = {"human": "user", "gpt": "assistant", "tool_result": "tool"}


def strip(text: Column) -> Column:
    """text without white space at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def content_text(value: Column, depth: int = 12) -> Column:
    """Plain text of a VARIANT that is null, a string, a list of blocks, or anything else.

    Of a list, strings and the `content` or `text` of objects count, stripped and
    joined by spaces; other blocks are left out. Lists within blocks are followed
    `depth` levels down.
    """
    kind = F.schema_of_variant(value)
    plain = F.when(kind == "VOID", F.lit("")).otherwise(F.coalesce(F.try_variant_get(value, "$", "string"), F.to_json(value)))
    if depth == 0:
        return F.coalesce(plain, F.lit(""))

    def block(x: Column) -> Column:
        kind = F.schema_of_variant(x)
        inner = F.coalesce(F.try_variant_get(x, "$.content", "variant"), F.try_variant_get(x, "$.text", "variant"))
        return F.when(kind == "STRING", F.try_variant_get(x, "$", "string")).when(kind.startswith("OBJECT") & inner.isNotNull(), content_text(inner, depth - 1)).otherwise("")

    parts = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda x: strip(block(x)))
    joined = F.array_join(F.filter(parts, lambda x: x != ""), " ")
    return F.coalesce(F.when(kind.startswith("ARRAY"), joined).otherwise(plain), F.lit(""))


def message_text(message: Column) -> Column:
    return F.coalesce(message["content"], F.lit(""))


def render(messages: Column) -> Column:
    """"[ROLE]: content" paragraphs of the messages that say something."""

    def one(m: Column) -> Column:
        role = F.upper(F.coalesce(F.nullif(m["role"], F.lit("")), F.lit("unknown")))
        return F.concat(F.lit("\n["), role, F.lit("]: "), strip(message_text(m)))

    spoken = F.filter(messages, lambda m: strip(message_text(m)) != "")
    return strip(F.array_join(F.transform(spoken, one), ""))


def normal_role(role: Column) -> Column:
    """The usual name of a role; user where there is none."""
    known = F.create_map(*[F.lit(x) for kv in ROLE_ALIASES.items() for x in kv])
    named = F.coalesce(F.nullif(role, F.lit("")), F.lit("user"))
    return F.coalesce(F.element_at(known, named), named)


def normalize(messages: Column) -> Column:
    """Messages with usual roles and without null contents; other fields stay."""
    return F.transform(messages, lambda m: m.withField("role", normal_role(m["role"])).withField("content", message_text(m)))


def key_values(fields: Mapping[str, Column]) -> Column:
    """"key: value" lines of the fields that are neither null nor empty."""
    lines = [F.when(v.cast("string") != "", F.concat(F.lit(f"{k}: "), v.cast("string"))) for k, v in fields.items()]
    return strip(F.array_join(F.filter(F.array(*lines), lambda x: x.isNotNull()), "\n"))


def fold_system(messages: Column) -> Column:
    """Messages for models without a system role: its texts go in front of the next user turn, or are one at the end."""
    pair = "struct<role:string,content:string>"
    start = F.struct(F.array().cast(f"array<{pair}>").alias("done"), F.array().cast("array<string>").alias("held"))

    def turn(role: Column, content: Column) -> Column:
        return F.struct(role.alias("role"), content.alias("content")).cast(pair)

    def step(acc: Column, m: Column) -> Column:
        text, role = message_text(m), m["role"]
        held = F.array_join(acc["held"], "\n")
        led = F.when(text != "", F.concat(held, F.lit("\n\n"), text)).otherwise(held)
        takes = (role == "user") & (F.size(acc["held"]) > 0)
        done = F.concat(acc["done"], F.array(turn(role, F.when(takes, led).otherwise(text))))
        kept = F.when(text != "", F.concat(acc["held"], F.array(text))).otherwise(acc["held"])
        quiet = F.struct(acc["done"].alias("done"), kept.alias("held"))
        said = F.struct(done.alias("done"), F.when(takes, F.array().cast("array<string>")).otherwise(acc["held"]).alias("held"))
        return F.when(role == "system", quiet).otherwise(said)

    def finish(acc: Column) -> Column:
        return F.when(F.size(acc["held"]) > 0, F.concat(acc["done"], F.array(turn(F.lit("user"), F.array_join(acc["held"], "\n"))))).otherwise(acc["done"])

    return F.aggregate(messages, start, step, finish)


def injection_text(injections: Column) -> Column:
    """Values of a map by ascending key, one a line."""
    entries = F.array_sort(F.map_entries(injections))
    return F.coalesce(strip(F.array_join(F.transform(entries, lambda e: e["value"]), "\n")), F.lit(""))


def fragments(text: Column, least: int = 40) -> Column:
    """Stripped lines of at least `least` characters, else the whole text, else none."""
    long = F.filter(F.transform(F.split(text, "\n+"), strip), lambda x: F.length(x) >= least)
    whole = F.when(strip(text) != "", F.array(strip(text))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(long) > 0, long).otherwise(whole)


def indices(messages: Column, wanted) -> Column:
    """Places (from 0) of the messages that wanted() holds for."""
    marked = F.transform(messages, lambda m, i: F.when(wanted(m), i))
    return F.filter(marked, lambda i: i.isNotNull())


def matching_tools(messages: Column, parts: Column, role: str = "tool") -> Column:
    """Places of the tool messages that contain any of the parts."""
    return indices(messages, lambda m: (m["role"] == role) & F.exists(parts, lambda f: F.contains(message_text(m), f)))


def locator(explicit: Column, parts: Column, text: Column, messages: Column, role: str = "tool") -> Column:
    """Places of injected tool messages, or null if nothing tells.

    A list of places counts even if empty; then fragments; then the injection's
    lines of 40 characters; then its whole text.
    """
    given = F.filter(F.transform(F.coalesce(parts, F.array().cast("array<string>")), strip), lambda x: x != "")
    used = F.when(F.size(given) > 0, given).otherwise(fragments(F.coalesce(text, F.lit(""))))
    found = matching_tools(messages, used, role)
    return F.when(explicit.isNotNull(), explicit.cast("array<int>")).when(F.size(found) > 0, found)


def task_prefix(messages: Column) -> Column:
    return F.filter(messages, lambda m: m["role"] == "system")


def task_text(messages: Column) -> Column:
    """The first user content, else the first system content, else nothing."""

    def first(role: str) -> Column:
        said = F.filter(messages, lambda m: m["role"] == role)
        return F.when(F.size(said) > 0, message_text(F.get(said, F.lit(0))))

    return F.coalesce(first("user"), first("system"), F.lit(""))


def tool_name(call: Column, name: Column) -> Column:
    """The called function's name: of an object, a string, or else the message's own name; call is a VARIANT or null."""
    function = F.try_variant_get(call, "$.function", "variant")
    kind = F.schema_of_variant(function)
    return F.when(kind.startswith("OBJECT"), F.try_variant_get(function, "$.name", "string")).when(kind == "STRING", F.try_variant_get(function, "$", "string")).otherwise(name)


def split_group(injected: Column, suite: Column, task: Column) -> Column:
    """Runs with one injection belong together, else those of one task."""
    clean = F.concat(F.lit("user:"), F.coalesce(suite, F.lit("None")), F.lit(":"), F.coalesce(task, F.lit("None")))
    return F.when(injected != "", F.concat(F.lit("injection:"), F.sha1(injected))).otherwise(clean)


def truthy(value: Column) -> Column:
    return F.coalesce(value, F.lit("")) != ""


def sample_id(source: Column, label: Column, text: Column) -> Column:
    return F.sha1(F.concat(F.coalesce(source, F.lit("")), F.lit("\n"), F.coalesce(label.cast("string"), F.lit("")), F.lit("\n"), F.coalesce(text, F.lit(""))))


def char_prefix(text: Column, budget: int) -> Column:
    """The longest prefix within a budget where each character is a token."""
    return F.substring(F.coalesce(text, F.lit("")), 1, max(0, budget))


def char_tokens(messages: Column) -> Column:
    return F.aggregate(messages, F.lit(0).cast("long"), lambda n, m: n + F.length(message_text(m)))
