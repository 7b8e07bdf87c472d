import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import chat as C
from tidemark.llm import template as T

SCHEMA = "conv_id long, turn long, role string, text string, spans string"
TRICKY = st.lists(st.sampled_from(["<|", "|>", "im_end", "<|im_end|>\n", "&lt;", "&", "&amp;", "</s>", "<s>", "[INST]", "[/INST]", "[", "|", "<", "\n", "x", "é", "&NewLine;"]), max_size=12).map("".join)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "a\nb", "<|im_start|>"]), TRICKY), max_size=5))
@settings(max_examples=300, deadline=None)
def test_round_trip(turns):
    text, spans = T.compile_template(C.TEMPLATE)(messages=[{"role": r, "text": t} for r, t in turns])
    assert C.read_back(text) == turns
    assert "".join(T.unescape(text[a:b]) for a, b in spans) == "".join(t for r, t in turns if r == "assistant")
    for control in ("</s>", "<s>", "[INST]", "[/INST]"):
        assert control not in text


def test_conversations(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [(1, 1, "assistant", "two", "s"), (1, 0, "user", "one", "s"), (2, 0, None, None, None), (3, None, "user", said, None), (3, 0, "assistant", said, None), (None, 0, "user", "n", None), (4, 0, "user", "same", None), (4, 0, "user", "same", None), (5, 0, "assistant", "y" * 100_000, None)]
    out = {r.conv_id: r for r in C.digests(C.formatted(spark.createDataFrame(rows, SCHEMA))).collect()}
    want = {1: [("user", "one"), ("assistant", "two")], 2: [("", "")], 3: [("user", said), ("assistant", said)], None: [("user", "n")], 4: [("user", "same")] * 2, 5: [("assistant", "y" * 100_000)]}
    assert out.keys() == want.keys()
    for k, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (out[k].n_turns, out[k].loss_chars) == (len(turns), len(loss))
        assert out[k].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert out[k].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert C.formatted(spark.createDataFrame([], SCHEMA)).count() == 0


def test_language():
    run = lambda source, **v: T.compile_template(source)(**v)[0]
    assert run("{% for x in xs %}{{ loop.index }}{% if not loop.last %}-{% endif %}{% endfor %}", xs=[5, 6]) == "1-2"
    assert run("{% set a = 1 + 2 %}{{ a ~ 'x' | upper }}") == "3X"
    assert run("{% if a == 1 %}one{% elif a > 2 and not b %}two{% else %}other{% endif %}", a=3) == "two"
    assert run("{{ m.a['b'][0] }}{{ m.missing }}{{ none }}", m={"a": {"b": [7]}}) == "7"
    assert run("a {#- note #}b  {{- 'c' -}}  d") == "abcd"


def test_constants_are_folded():
    tree = T.fold(T.parse("{% if 1 == 2 %}no{% elif 'a' in 'abc' %}yes{% endif %}{{ 'p' + 'q' | upper }}{{ x }}"))
    assert [type(n) for n in tree] == [T.Emit, T.Emit] and tree[0].value == T.Const("yespQ")


def test_sandbox():
    run = T.compile_template("{{ x.__class__ }}{{ x.real }}|{{ 'a'.upper }}")
    assert run(x=3)[0] == "|"
    for bad in ("{% for x in %}", "{% if x %}", "{{ f(1) }}", "{{ x | eval }}", "{% endfor %}", "{% import os %}", "{{ }}", "{% else %}"):
        with pytest.raises(T.TemplateError):
            T.compile_template(bad)


def test_generation_blocks_do_not_nest():
    inner = "{% generation %}a{% if x %}{% generation %}b{% endgeneration %}{% endif %}{% endgeneration %}"
    with pytest.raises(T.TemplateError, match="within generation"):
        T.compile_template(inner)
    beside = "{% generation %}a{% endgeneration %}-{% generation %}b{% endgeneration %}"
    assert T.compile_template(beside)() == ("a-b", [(0, 1), (2, 3)])
