import numpy as np
import pytest

from driftspark.llm import chat, wavelet
from driftspark.llm.common import load


def render(source, **values):
    return chat.compile_template(source)(values)


@pytest.mark.parametrize(
    "source,values,want",
    [
        ("a{{ 1 + 2 * 3 }}b", {}, "a7b"),
        ("{{ 'x' ~ 1 ~ none }}", {}, "x1None"),
        ("{{ m.role | upper }}{{ m['no'] }}", {"m": {"role": "u"}}, "U"),
        ("{% if a and not b %}1{% elif b %}2{% else %}3{% endif %}", {"a": True, "b": True}, "2"),
        ("{% for x in xs %}{{ loop.index }}{{ x }}{% if not loop.last %},{% endif %}{% endfor %}", {"xs": ["a", "b"]}, "1a,2b"),
        ("{%- for x in xs -%}\n {{ x }} \n{%- endfor -%}", {"xs": [1, 2]}, "12"),
        ("{% set n = 1 %}{% for x in xs %}{% set n = x %}{% endfor %}{{ n }}", {"xs": [5]}, "1"),
        ("{{ xs[1:] | join('-') }}{{ xs[-1] }}{{ xs | length }}", {"xs": ["a", "b", "c"]}, "b-cc3"),
        ("{{ 'yes' if x is defined else 'no' }}{{ x | default('d') }}", {}, "nod"),
        ("{{ 'b' in 'abc' }}{{ 'z' not in ['a'] if false else 1 }}", {}, "True1"),
        ("{# note #}{{ '%s' }}{{ \"q\\n\" }}", {}, "%sq\n"),
        ("{{ 7 // 2 }}{{ 7 % 2 }}{{ -3 + 1 }}", {}, "31-2"),
        ("{% for x in xs if x > 1 %}{{ loop.index }}{{ x }}{{ loop.nextitem }} {% else %}none{% endfor %}", {"xs": [1, 2, 3]}, "123 23 "),
        ("{% for x in xs if x > 9 %}{{ x }}{% else %}none{% endfor %}", {"xs": [1]}, "none"),
        ("{% set ns = namespace(n=0, last='') %}{% for x in xs %}{% set ns.n = ns.n + x %}{% set ns.last = x %}{% endfor %}{{ ns.n }}{{ ns.last }}", {"xs": [1, 2, 4]}, "74"),
        ("{{ x.strip().upper() }}{{ x.startswith(' a') }}{{ x.split('b')[0] }}|{{ x.endswith(['c', 'b ']) }}", {"x": " ab "}, "ABTrue a|True"),
        ("{% for k, v in m.items() %}{{ k }}={{ v }};{% endfor %}{{ m.get('z', 0) }}{{ m | length }}", {"m": {"a": 1, "b": None}}, "a=1;b=None;02"),
        ("{{ m | tojson(indent=1) }}{{ '' | default('d', true) }}{{ '' | default('d') }}{{ xs | join(sep='+') }}", {"m": {"a": 1}, "xs": [1, 2]}, '{\n "a": 1\n}d1+2'),
        ("{{ ms | selectattr('role', 'equalto', 'user') | map(attribute='content') | join(',') }}{{ ms | rejectattr('role', 'eq', 'user') | list | length }}", {"ms": [{"role": "user", "content": "a"}, {"role": "tool", "content": "b"}, {"role": "user", "content": "c"}]}, "a,c1"),
        ("{% for m in messages[::-1] %}{{ m.content }}{% endfor %}{{ messages[:-1] | length }}", {"messages": [{"content": "a"}, {"content": "b"}]}, "ba1"),
        ("{% set sys = messages[0].content if messages[0].role == 'system' else '' %}{% set rest = messages[1:] if sys else messages %}[{{ sys }}]{% for m in rest %}{% if (m.role == 'user') != (loop.index0 % 2 == 0) %}{{ raise_exception('turns') }}{% endif %}{{ m.content | trim }}/{% endfor %}", {"messages": [{"role": "system", "content": "S"}, {"role": "user", "content": " q "}, {"role": "assistant", "content": "a"}]}, "[S]q/a/"),
        ("{% if tools is not none and tools is defined %}t{% endif %}{% for i in range(2, 5) %}{{ i }}{% endfor %}{{ {'a': [1, 2]}['a'][1] }}{{ 3 is odd }}", {"tools": None}, "2342True"),
        ("a\n  {%- if true -%}  b  {%- endif %} c {{- ' d' }}{{ -1 }}", {}, "ab c d-1"),
    ],
)
def test_templates(source, values, want):
    assert render(source, **values)[0] == want


@pytest.mark.parametrize("source", ["{% if x %}", "{{ a b }}", "{% endfor %}", "{{ x.__class__() }}", "{{ 1 | nothing }}", "{% while x %}{% endwhile %}", "{{ ranges(3) }}", "{{ x.encode() }}", "{{ x.format(1) }}", "{{ x | join(of=1) }}", "{{ x[] }}", "{{ " + "(" * 5000 + "1" + ")" * 5000 + " }}", "{{ " + "9" * 5000 + " }}", "{% if x %}" * 3000 + "{% endif %}" * 3000, "{{ open('f') }}", "{{ 'x }}", "{{ }}"])
def test_templates_that_cannot_be_compiled(source):
    with pytest.raises(chat.TemplateError):
        chat.compile_template(source)


@pytest.mark.parametrize("source", ["{{ 'abc'['a':'b'] }}", "{{ 'abc'[1.5:] }}", "{{ 'abc'[::0] }}", "{{ none | length }}", "{{ 1 | int | join }}", "{{ 'a' | replace }}", "{{ {[1]: 2} }}", "{{ 1.startswith('a') }}", "{{ none.items() }}", "{{ 'a'.startswith(1) }}", "{{ range(999999999) }}", "{% set x = 1 %}{% set x.y = 2 %}", "{% for a, b in [1] %}{% endfor %}", "{{ 'x' | int }}", "{{ [3, 'a'] | sort }}", "{{ 1e9 }}", "{{ x + 1 }}", "{{ 'a' * 9 }}", "{{ '%d' % 1 }}", "{% for c in 'ab' %}{% endfor %}", "{{ raise_exception('no') }}", "{{ 1 / 0 }}"])
def test_templates_that_fail_on_values(source):
    with pytest.raises(chat.TemplateError):
        render(source)


def test_values_give_no_access_to_python():
    assert render("{{ x.__class__ }}{{ x.upper }}{{ m.items }}", x="a", m={"b": 1})[0] == ""


def test_folding_leaves_constants():
    assert chat.simplify(chat.parse("a{{ 1 + 1 }}{% if false %}b{% else %}c{% endif %}")) == [("text", "a2c")]
    assert chat.fold(chat._Expr("x + 'a' + 'b'").whole()) == ("op", "+", ("name", "x"), ("lit", "ab"))
    assert chat.fold(chat._Expr("true or y").whole()) == ("lit", True)


def test_generation_marks_are_in_characters():
    text, spans = render("é{% generation %}ab{% endgeneration %}-{% generation %}{% endgeneration %}")
    assert text == "éab-" and spans == [(1, 3), (4, 4)]


def test_conversations_agree_with_plain_python(spark, sf):
    turns = load(spark, sf, "conversations")
    by = {}
    for r in turns.collect():
        by.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    rows = chat.format_chats(turns).collect()
    assert len(rows) == len(by)
    for r in rows:
        want, spans = "", []
        for _, role, text in sorted(by[r.conv_id]):
            want += f"<|im_start|>{role}\n"
            start = len(want)
            want += text + "<|im_end|>"
            if role == "assistant":
                spans.append(f"{start}-{len(want)}")
            want += "\n"
        assert (r.text, r.spans, r.error, r.n_turns) == (want, ",".join(spans), None, len(by[r.conv_id]))


def test_conversation_edge_cases(spark):
    rows = [(1, 0, "user", "hi", "x"), (1, 0, "user", "hi", "x"), (1, 1, None, None, None), (None, None, "assistant", "lone", "y"), (2, 0, "assistant", "", "z"), (3, 0, "user", "w " * 200_000, "z"), (1, None, "system", "s", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, spans string")
    got = {r.conv_id: r for r in chat.format_chats(turns).collect()}
    assert got[1].text == "<|im_start|>system\ns<|im_end|>\n" + "<|im_start|>user\nhi<|im_end|>\n" * 2 + "<|im_start|>user\n<|im_end|>\n"
    assert got[None].spans == "22-36" and got[2].spans == "22-32" and len(got[3].text) > 400_000
    assert chat.format_chats(turns.where("false")).count() == 0
    strict = "{% for m in messages %}{% if m.role != 'user' %}{{ raise_exception('only users') }}{% endif %}{{ m.content }}{% endfor %}"
    by = {r.conv_id: r for r in chat.format_chats(turns, strict).collect()}
    assert by[2].error == "only users" and by[2].text is None and by[3].error is None
    with pytest.raises(chat.TemplateError):
        chat.format_chats(turns, "{% for %}")
    wrong = {r.conv_id: r for r in chat.format_chats(turns, "{{ messages[0].content['a':'b'] }}").collect()}
    assert all(r.text is None and r.error for r in wrong.values()) and len(wrong) == 4


@pytest.mark.parametrize("n,vocabulary,block", [(0, 5, 64), (1, 1, 64), (1000, 50_000, 64), (5000, 7, 1 << 18), (700, 1 << 20, 128)])
def test_wavelet_matrix_agrees_with_the_list(monkeypatch, n, vocabulary, block):
    monkeypatch.setattr(wavelet, "BLOCK", block)
    rng = np.random.default_rng(n)
    ids = rng.integers(0, vocabulary, n)
    w = wavelet.WaveletMatrix(wavelet.encode(ids))
    assert len(w) == n and (w.decode() == ids).all()
    assert (w.access(np.arange(n)) == ids).all() if n else w.access([]).size == 0
    for token in [*ids[:5].tolist(), 0, vocabulary, 1 << 40, -1]:
        assert w.count(token) == (ids == token).sum()
        assert w.occurrences(token).tolist() == np.flatnonzero(ids == token).tolist()
        assert w.rank(token, n // 2) == (ids[: n // 2] == token).sum()
    with pytest.raises(IndexError):
        w.access([n])


def test_files_of_another_kind_are_refused():
    with pytest.raises(ValueError):
        wavelet.WaveletMatrix(b"nothing of the kind")


def decoded(rows):
    enc = wavelet.tokenizer(wavelet.VOCABULARY, wavelet.PATTERN)
    for r in rows:
        w = wavelet.WaveletMatrix(bytes(r.data))
        assert r.n_tokens == len(w) == r.offsets[-1] and r.n_docs == len(r.doc_ids) == len(r.offsets) - 1
        for i, doc in enumerate(r.doc_ids):
            ids = w.access(np.arange(r.offsets[i], r.offsets[i + 1])) if r.offsets[i] < r.offsets[i + 1] else []
            yield doc, enc.decode([int(x) for x in ids])


def test_shards_round_trip(spark, sf, tmp_path):
    docs = load(spark, sf, "documents").repartition(3)
    shards = wavelet.token_shards(docs, shard_tokens=5000).persist()
    want = {r.doc_id: r.text for r in docs.collect()}
    assert dict(decoded(shards.collect())) == want
    files = wavelet.write_files(shards, str(tmp_path / "out")).collect()
    for r in files:
        with open(r.path, "rb") as f:
            assert len(f.read()) == r.bytes
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == sorted(r.path.rpartition("/")[2] for r in files)


def test_shard_edge_cases(messy, empty):
    got = sorted(decoded(wavelet.token_shards(messy, shard_tokens=1000).collect()), key=str)
    want = sorted(((r.doc_id, r.text or "") for r in messy.collect()), key=str)
    assert got == want
    assert wavelet.token_shards(empty).count() == 0
