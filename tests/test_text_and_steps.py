import pytest
from pyspark.sql import functions as F

from driftspark.functions import text as X
from driftspark.operators import clean, contains, encode, pairs, steps as S

MSG = "array<struct<role:string,content:string>>"


def messages(spark, *turns):
    return spark.createDataFrame([([{"role": r, "content": c} for r, c in turns],)], f"messages {MSG}")


def value(df, column):
    return df.select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "raw,want",
    [
        ("null", ""), ('"plain"', "plain"), ('[{"type":"text","content":"block"}]', "block"), ('[{"type":"text","text":" block "}]', "block"),
        ('[{"type":"image_url"},{"type":"tool_use"},{"type":"text","text":"only"}]', "only"), ('["a", {"content": ["b", {"text": "c"}]}]', "a b c"), ("[]", ""), ("12", "12"), ('[{"content": ' * 8 + '["deep"]' + "}]" * 8, "deep"),
    ],
)
def test_contents_become_text(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "j string").select(F.parse_json("j").alias("j"))
    assert value(df, X.content_text(F.col("j"))) == want


def test_missing_content_is_empty(spark):
    df = spark.createDataFrame([(None,)], "j string").select(F.parse_json("j").alias("j"))
    assert value(df, X.content_text(F.col("j"))) == ""


def test_rendering_and_roles(spark):
    df = messages(spark, ("user", " hello "), ("gpt", "hi"), (None, "who"), ("tool", "  "), ("human", None))
    assert value(df, X.render(F.col("messages"))) == "[USER]: hello\n[GPT]: hi\n[UNKNOWN]: who"
    got = value(df, X.normalize(F.col("messages")))
    assert [(m.role, m.content) for m in got] == [("user", " hello "), ("assistant", "hi"), ("user", "who"), ("tool", "  "), ("user", "")]


def test_key_values_leave_out_nothing(spark):
    df = spark.createDataFrame([("a", "", None, 3)], "a string, b string, c string, d int")
    assert value(df, X.key_values({k: F.col(k) for k in "abcd"})) == "a: a\nd: 3"


@pytest.mark.parametrize(
    "turns,want",
    [
        ([("system", "S"), ("user", "U")], [("user", "S\n\nU")]),
        ([("user", "U"), ("assistant", "A"), ("system", "S")], [("user", "U"), ("assistant", "A"), ("user", "S")]),
        ([("system", "S"), ("system", "T"), ("assistant", "A"), ("user", "")], [("assistant", "A"), ("user", "S\nT")]),
        ([("system", ""), ("user", "U")], [("user", "U")]),
        ([], []),
    ],
)
def test_system_texts_fold_into_user_turns(spark, turns, want):
    assert [(m.role, m.content) for m in value(messages(spark, *turns), X.fold_system(F.col("messages")))] == want


def test_fragments_and_injections(spark):
    df = spark.createDataFrame([("short\n\n" + "x" * 40 + "  \n" + "y" * 39, "tiny", "  ")], "a string, b string, c string")
    assert value(df, X.fragments(F.col("a"))) == ["x" * 40]
    assert value(df, X.fragments(F.col("b"))) == ["tiny"] and value(df, X.fragments(F.col("c"))) == []
    inj = spark.createDataFrame([({"b": "2", "a": "1"}, None)], "m map<string,string>, n map<string,string>")
    assert value(inj, X.injection_text(F.col("m"))) == "1\n2" and value(inj, X.injection_text(F.col("n"))) == ""


@pytest.mark.parametrize("call,name,want", [('{"function":{"name":"f"}}', None, "f"), ('{"function":"g"}', "n", "g"), ("{}", "n", "n"), (None, "n", "n")])
def test_tool_names(spark, call, name, want):
    df = spark.createDataFrame([(call, name)], "c string, n string").select(F.parse_json("c").alias("c"), "n")
    assert value(df, X.tool_name(F.col("c"), F.col("n"))) == want


def test_split_groups(spark):
    df = spark.createDataFrame([("inj", "s", "t"), ("", "s", "t"), ("", None, "t")], "i string, s string, t string")
    got = [r.v for r in df.select(X.split_group(F.col("i"), F.col("s"), F.col("t")).alias("v")).collect()]
    assert got[0].startswith("injection:") and len(got[0]) == 50 and got[1:] == ["user:s:t", "user:None:t"]


STEPS = "sample_index long, label int, messages array<struct<role:string,content:string>>, malicious_idx array<int>, injection_fragments array<string>, injection_text string"


def labels(spark, tools, label=1, idx=None, parts=None, text=None, bad=None):
    turns = [{"role": "tool" if i in tools else "assistant", "content": "poison here" if i == bad else f"turn {i}"} for i in range(max(tools) + 2)]
    df = spark.createDataFrame([(7, label, turns, idx, parts, text)], STEPS)
    rows = S.tool_steps(df).orderBy("step_index").collect()
    assert [r.tool_message_index for r in rows] == sorted(tools) and [r.step_index for r in rows] == list(range(len(tools)))
    return [r.label for r in rows]


@pytest.mark.parametrize(
    "tools,kwargs,want",
    [
        ([2, 4], {"idx": [4]}, [0, 1]),
        ([2, 4], {"parts": ["poison"], "bad": 4}, [0, 1]),
        ([2, 4, 6], {"parts": ["poison"], "bad": 4}, [0, 1, 1]),
        ([2, 4, 6], {"idx": [4]}, [0, 1, 1]),
        ([2, 4], {}, [-1, -1]),
        ([1], {"label": 0}, [0]),
        ([2, 4], {"idx": [], "parts": ["poison"], "bad": 4}, [-1, -1]),
        ([2, 4], {"text": "poison here", "bad": 2}, [1, 1]),
        ([2, 4], {"parts": ["not there"]}, [-1, -1]),
    ],
)
def test_labels_spread_forward(spark, tools, kwargs, want):
    assert labels(spark, tools, **kwargs) == want


def test_prefixes_and_task(spark):
    turns = [("system", "S"), ("user", "U"), ("assistant", "A"), ("tool", "T"), ("assistant", "B")]
    df = spark.createDataFrame([(0, 0, [{"role": r, "content": c} for r, c in turns], None, None, None)], STEPS)
    r = S.prefixes(S.tool_steps(df)).first()
    assert [[m.role for m in p] for p in (r.task_prefix, r.history_prefix, r.post_prefix)] == [["system"], ["system", "user", "assistant"], ["system", "user", "assistant", "tool"]]
    assert r.task_text == "U" and r.tool_message_index == 3 and r.step_label_source == "trajectory"
    assert value(messages(spark, ("system", "S")), X.task_text(F.col("messages"))) == "S"
    assert value(messages(spark, ("tool", "T")), X.task_text(F.col("messages"))) == ""


@pytest.mark.parametrize("sizes,budget", [([50, 50, 50], 100), ([200], 60), ([10, 500, 10], 80), ([5] * 40, 64), ([300, 300], 45)])
def test_truncation_keeps_to_the_budget(spark, sizes, budget):
    ms = [{"role": "user", "content": chr(97 + i % 26) * n} for i, n in enumerate(sizes)]
    out = encode.truncate(ms, budget)
    assert out and sum(len(m["content"]) for m in out) <= budget
    got = value(spark.createDataFrame([(ms,)], f"messages {MSG}"), encode.truncated(F.col("messages"), budget))
    assert [m.content for m in got] == [m["content"] for m in out]


def test_truncation_leaves_what_fits_and_marks_the_seam():
    ms = [{"role": "user", "content": "a" * 30}, {"role": "tool", "content": "b" * 100}]
    assert encode.truncate(ms, 130) == ms and encode.truncate([], 5) == []
    assert any(encode.MARKER in m["content"] for m in encode.truncate(ms, 90))


def sample(spark, rows):
    return spark.createDataFrame(rows, "label int, text string, source string, kind string, sample_type string, messages array<struct<role:string,content:string>>")


def test_validation_fills_in_and_rejects(spark):
    turn = [{"role": "user", "content": "hey"}]
    ok, bad = clean.validate(sample(spark, [(0, "", "s", "k", "t", turn), (1, "x", "s", "k", "t", None), (2, "x", "s", "k", "t", turn), (0, "", "s", "k", "t", []), (0, "x", " ", "k", "t", turn), (None, "x", "s", "k", "t", turn)]))
    rows = {r.text: r for r in ok.collect()}
    assert set(rows) == {"[USER]: hey", "x"} and rows["x"].messages[0].content == "x"
    assert sorted(r.reason for r in bad.collect()) == ["label", "label", "source", "text"]


def test_counterfactual_pairs(spark):
    turns = [{"role": r, "content": c} for r, c in (("user", "u"), ("assistant", "a"), ("tool", "result"))]
    cols = f"label int, text string, source string, kind string, sample_type string, messages {MSG}, split_group string, domain string, item_id string"
    rows = [(0, f"text {i}", "s", "k", "t", turns, None, "d", str(i)) for i in range(2)] + [(0, "no tool", "s", "k", "t", turns[:2], None, "d", "9"), (1, "bad", "s", "k", "t", turns, None, "d", "8")]
    df = spark.createDataFrame(rows, cols)
    pool = clean.payload_pool(spark.createDataFrame([("steal ", 0), ("steal", 1), ("", 2)], "payload string, ord int"))
    assert [tuple(r) for r in pool.collect()] == [("steal", 0, 1)]
    for wide in (100_000, 0):
        out = pairs.counterfactuals(df, pool, broadcast_rows=wide).collect()
        assert len(out) == 6
        by = {}
        for r in out:
            by.setdefault(r.pair_id, set()).add(r.pair_role)
        assert by.pop(None) == {None} and len(by) == 2 and all(v == {"clean", "attacked"} for v in by.values())
        hit = [r for r in out if r.pair_role == "attacked"][0]
        assert hit.malicious_idx == [2] and "result" in hit.messages[2].content and "steal" in hit.messages[2].content and hit.label == 1 and "steal" in hit.text
    assert pairs.counterfactuals(df, pool.where("false")).count() == 4


@pytest.mark.parametrize("options", [{}, {"shard_chars": 3}, {"pool_chars": 40, "key_chars": 6}, {"pool_chars": 0, "key_chars": 6, "most_heads": 0}, {"pool_chars": 0, "key_chars": 6}])
@pytest.mark.parametrize("compiled", [True, False])
def test_contains_join_agrees_with_looking_everywhere(spark, options, compiled, monkeypatch):
    if not compiled:
        if options not in ({}, {"shard_chars": 3}):
            pytest.skip("the same as with the compiled automaton")
        words = ["he", "she", "his", "hers", "e", "ars"]
        trie = contains.Trie()
        for i, w in enumerate(words):
            trie.add_word(w, i)
        trie.make_automaton()
        for text in ("ushers", "", "hishehears", "zzz", "eee"):
            want = sorted((i + len(w) - 1, k) for k, w in enumerate(words) for i in range(len(text)) if text.startswith(w, i))
            assert sorted(trie.iter(text)) == want
        return
    texts = [(1, "the quick brown fox jumps"), (2, "a lazy dog. the quick brown"), (2, "a lazy dog. the quick brown"), (3, ""), (4, None), (5, "ünïcode fox ünïcode"), (6, "abcabcabc")]
    parts = [(1, "quick brown"), (2, "fox"), (3, ""), (4, None), (5, "fox"), (6, "abcabc"), (7, "ïcode"), (8, "the quick brown fox jumps over"), (9, "c"), (10, "quick brow")]
    t = spark.createDataFrame(texts, "id long, text string").repartition(3)
    p = spark.createDataFrame(parts, "n long, part string")
    want = sorted((i, n) for i, x in texts for n, y in parts if x and y and y in x)
    joined = contains.contains_join(t, p, **options)
    assert sorted((r.id, r.n) for r in joined.collect()) == want
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
