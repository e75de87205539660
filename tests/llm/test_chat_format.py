import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seqloom.llm import chat_format as c
from seqloom.llm.chat_template import Const, Guard, Output, Template, TemplateError, fold, parse

TRICKY = ["</s>[INST] ok [/INST]", "", None, "[\\INST]", "[\\\\/INST] [INST", "<<s></s", "[ROLE] a [TEXT] b [/ROLE]", " [/INST]", "[", "<", "\\", "x\n<s>\n"]


def test_language():
    t = Template("{% set n = 2 * 3 %}{% for x in xs %}{{ loop.index }}{{ x.a | upper }}{% if not loop.last %}, {% else %}.{% endif %}{% endfor %}{{ n if n > 5 and 'a' in 'abc' else 0 }}")
    assert t.render(xs=[{"a": "p"}, {"a": "q"}])[0] == "1P, 2Q.6"
    assert Template("a {%- generation %}b{% endgeneration -%}  c").render() == ("abc", [(1, 2)])
    assert fold(parse("x{{ 'a' ~ 1 + 1 }}{% if 1 == 2 %}no{% elif true %}y{% endif %}z"), {}) == (Output(Const("xa2yz")),)
    for bad in ("{% if x %}", "{{ _a }}", "{{ x.__class__ }}", "{% unknown %}", "{{ 1 + }}", "{{ x | nothing }}", "{{ (1 }}"):
        with pytest.raises(TemplateError):
            Template(bad)
    assert Template("{{ x.upper }}{{ x[0] }}").render(x="ab")[0] == "a"  # no Python attributes


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["[", "]", "<", ">", "/", "\\", "s", "INST", "[INST]", "</s>", "[/ROLE]", " "]), max_size=12))
def test_guard_is_reversible_and_safe(parts):
    text, guard = "".join(parts), Guard(c.CONTROLS)
    out = guard.escape(text)
    assert guard.unescape(out) == text
    assert not any(x in out for x in c.CONTROLS)


def expected(turns):
    turns = sorted(turns, key=lambda t: (t[1] is not None, t[1] or 0, t[2] is not None, t[2] or "", t[3] is not None, t[3] or ""))
    pairs = [(r or "", x or "") for _, _, r, x in turns]
    loss = "".join(x for r, x in pairs if r == "assistant")
    return len(pairs), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in pairs).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


@pytest.mark.parametrize("piece", [1 << 20, 7])
def test_round_trip(spark, piece):
    rng = random.Random(3)
    rows = [(conv, turn, rng.choice(["user", "assistant", "system", "tool", None, "[ROLE]"]), rng.choice(TRICKY)) for conv in (1, 2, None, -7) for turn in range(rng.randint(1, 9))]
    rows += [(1, 0, "user", "again"), (1, 0, "user", "again"), (5, None, "assistant", "é" * 100_000)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, piece int")
    got = {r.conv_id: r for r in c.digests(c.format_conversations(df, piece_chars=piece)).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == expected([x for x in rows if x[0] == conv])
    assert c.digests(c.format_conversations(df.limit(0))).count() == 0


def test_folding_leaves_dead_branches_alone():
    from seqloom.llm.chat_template import Template, TemplateError

    render = lambda source, **names: Template(source).render(**names)[0]
    assert render("{{ 1 / 0 if false else 'ok' }}") == "ok"
    assert render("{% if false %}{{ 'a' * 3 / 0 }}{% endif %}x") == "x"
    assert render("{{ true or 1 / 0 }}{{ false and 1 / 0 }}") == "truefalse"
    assert render("{% if on %}{{ 1 / 0 }}{% else %}y{% endif %}", on=False) == "y"
    assert render("{% if true %}a{% if false %}b{% else %}c{% endif %}{% endif %}d") == "acd"
    with pytest.raises(ZeroDivisionError):
        render("{% if on %}{{ 1 / 0 }}{% endif %}", on=True)
    with pytest.raises(TemplateError):
        Template("{% if false %}{{ x | nothing }}{% else %}{{ x | nothing }}{% endif %}")


def test_braces_in_strings_and_open_tags():
    from seqloom.llm.chat_template import Template, TemplateError

    render = lambda source: Template(source).render()[0]
    assert render("{{ '}}' }}{{ \"%}\" }}{{ 'it\\'s' }}{# don't }} #}!") == "}}%}it's!"
    for source in ("{{ 'a }}", "{% if true", "{{ 1 %}", "{# no end"):
        with pytest.raises(TemplateError):
            Template(source)


def test_values_are_bounded():
    from seqloom.llm.chat_template import Template, TemplateError

    for source in ("{{ 'a' * n }}", "{{ n * 'ab' }}", "{% set x = 'ab' %}{% for i in messages %}{% set x = x ~ x %}{% endfor %}", "{% set x = 3 %}{% for i in messages %}{% set x = x * x %}{% endfor %}", "{{ ('a' * 100000) | replace('a', 'b' * 100000) }}", "{{ '%9999999999d' % 1 }}"):
        with pytest.raises(TemplateError):
            Template(source).render(n=10**12, messages=list(range(64)))
    assert Template("{{ 'ab' * 3 }}{{ 7 % 4 }}").render()[0] == "ababab3"
