import pytest
from hypothesis import given
from hypothesis import strategies as st

from granary.llm import chat

TEXT = st.text(alphabet="<|\\>ai_ms\n é", max_size=30)


@given(TEXT)
def test_escape_round_trip(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "<|x", "a\nb", ""]), TEXT), max_size=6))
def test_conversation_round_trip(turns):
    text, mask = chat.compile_template(chat.CHATML)([{"role": r, "text": t} for r, t in turns])
    assert chat.read_turns(text) == turns
    assert [chat.unescape(text[s:e]) for s, e in mask] == [t for r, t in turns if r == "assistant" and t]


def test_folding():
    tree = chat.fold(chat.parse("a{{ 'b' + 'c' | upper }}{% if 'x' == 'x' %}d{% else %}e{% endif %}{{ m }}{% if not 'y' %}z{% endif %}f"))
    assert tree == ("block", ("out", ("const", "abCd")), ("out", ("path", ("m",))), ("out", ("const", "f")))


def test_language():
    render = chat.compile_template("{% for m in messages %}{% if m.role == 'user' and m.text != '' or m.role == \"x\" %}[{{ m.text | trim | upper }}]{% endif %}{{ m.nothing.more }}{% endfor %}")
    assert render([{"role": "user", "text": " hi "}, {"role": "user", "text": ""}, {"role": "x", "text": "q"}])[0] == "[HI][Q]"


MESSAGES = [{"role": "system", "content": " be brief "}, {"role": "user", "content": "hi"}, {"role": "assistant", "content": "yes"}]


@pytest.mark.parametrize(
    ("template", "wanted"),
    [
        ("{% for m in messages %}{{ loop.index }}{{ loop.index0 }}{% if loop.first %}F{% elif loop.last %}L{% else %}-{% endif %}{{ loop.length }} {% endfor %}", "10F3 21-3 32L3 "),
        ("{% if messages[0]['role'] == 'system' %}{% set said = messages[0].content | trim %}{% set rest = messages[1:] %}{% else %}{% set rest = messages %}{% endif %}{{ said }}/{{ rest | length }}/{{ rest[-1]['content'] }}", "be brief/2/yes"),
        ("  a \n{%- for m in messages -%} \n {{- m.role[0] }} {%- endfor %}  b{#- gone -#}  c", "  asua  bc"),
        ("{% set x = 1 %}{% for m in messages %}{{ x }}{% set x = x + 1 %}{{ x }} {% endfor %}{{ x }}", "12 12 12 1"),
        ("{{ 'a' if 'sys' in messages[0].role else 'b' }}{{ 'c' if none }}{{ 'd' if 'q' not in messages[0] else 'e' }}", "ad"),
        ("{% if bos_token is defined %}{{ bos_token }}{% endif %}{{ nothing is defined }}{{ nothing is none }}{{ messages is not none }}{{ messages[9].role is not defined }}", "<s>FalseTrueTrueTrue"),
        ("{{ 1 + 2 }}{{ 1 ~ 2 }}{{ 'n' + 3 }}{{ true }}{{ messages[true] }}{{ messages['__class__'] }}{{ none[0] }}{{ 'abc'[1:] }}", "312n3Truebc"),
        ("{% for m in nothing %}x{% endfor %}{% for m in 5 %}x{% endfor %}{% if add_generation_prompt %}go{% endif %}", "go"),
    ],
)
def test_what_published_templates_use(template, wanted):
    assert chat.compile_template(template)(MESSAGES, add_generation_prompt=True, bos_token="<s>")[0] == wanted


def test_published_form():
    """A template as models are published with: turns by message['role'], a prompt at the end, the mask under assistant turns."""
    template = "{{- bos_token }}{%- for message in messages %}{%- if message['role'] == 'assistant' %}{{- '[A]' }}{% generation %}{{- message['content'] | trim + eos_token }}{% endgeneration %}{%- else %}{{- '[' ~ message['role'] | upper ~ ']' ~ message['content'] | trim }}{%- endif %}{%- endfor %}{%- if add_generation_prompt %}{{- '[A]' }}{%- endif %}"
    text, mask = chat.compile_template(template)(MESSAGES, bos_token="<s>", eos_token="</s>", add_generation_prompt=True)
    assert text == "<s>[SYSTEM]be brief[USER]hi[A]yes</s>[A]"
    assert [text[s:e] for s, e in mask] == ["yes</s>"]


def test_set_does_not_outlive_a_render():
    render = chat.compile_template("{{ x }}{% set x = 'a' %}{{ x }}")
    assert [render([])[0], render([])[0]] == ["a", "a"]


@pytest.mark.parametrize("bad", ["{{ a", "{% for m in messages %}", "{% endif %}", "{{ a | evil }}", "{{ a.b( }}", "{{ }}", "{% if a %}{% else %}", "{% for if in a %}{% endfor %}", "{{ 'a' b }}", "{{ a[0 }}", "{{ a[0:1:2] }}", "{% set if = 'x' %}", "{% elif a %}", "{% if a %}{% elif %}{% endif %}", "{{ a is odd }}", "{{ a if }}", "{% set none = 1 %}", "{{ messages.__class__ }}", "{{ _x }}"])
def test_errors(bad):
    if bad == "{{ a":
        assert chat.compile_template(bad)([])[0] == bad  # an opening alone is text
    else:
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)


def test_frames(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (None, 0, None, None), (1, None, "system", "s"), (2, 0, "assistant", "<|im_end|>"), (2, 0, "assistant", "<|im_end|>"), (3, 0, "user", "x" * 200000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as id", "2 as formatted")
    formatted = chat.format_conversations(df)
    got = {r["id"]: r for r in formatted.collect()}
    assert [x[0] for x in chat.read_turns(got[1]["formatted"])] == ["system", "user", "assistant"]
    d = {r["conv_id"]: r for r in chat.digests(formatted).collect()}
    assert (d[None]["n_turns"], d[2]["n_turns"], d[2]["loss_chars"], d[1]["loss_chars"]) == (1, 2, 20, 1)
    assert chat.format_conversations(df.limit(0)).count() == 0
