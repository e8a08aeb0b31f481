import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat_format as C
from tidemark.llm import template as T

ROWS = [
    (1, 0, "user", "hi"),
    (1, 1, "assistant", "a\\b </s>[INST] ok [/INST] <|done|>"),
    (1, 2, None, None),
    (2, 0, "assistant", ""),
    (2, 1, "assistant", "\\"),
    (2, 1, "assistant", "\\"),
    (3, 5, "as<|says|>sistant\n", "x" * 300 + "<|turn|>"),
    (None, 1, "user", "null id"),
    (None, 0, "assistant", "日本\n語 é"),
    (4, None, "assistant", "no turn"),
    (4, None, "assistant", None),
]
SCHEMA = "conv_id long, turn long, role string, text string, chunk int, n_turns string"


def expected(rows):
    out = {}
    order = sorted(rows, key=lambda r: ((r[0] is not None, r[0]), (r[1] is not None, r[1]), (r[2] is not None, r[2] or ""), (r[3] is not None, (r[3] or "").encode())))
    for conv in dict.fromkeys(r[0] for r in order):
        turns = [(r[2] or "", r[3] or "") for r in order if r[0] == conv]
        said = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (
            len(turns),
            hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
            len(said),
            hashlib.sha256(said.encode()).hexdigest(),
            sum(len(C.BEGIN + C.SAYS + C.END + C.escape(r) + C.escape(t)) + 1 for r, t in turns) - 1,
        )
    return out


@pytest.mark.parametrize("chunk", [C.CHUNK, 1, 7])
def test_round_trip(spark, chunk):
    df = spark.createDataFrame([(*r, 1, "x") for r in ROWS], SCHEMA).repartition(3)
    made = C.format_conversations(df, chunk=chunk)
    got = {r[0]: tuple(r)[1:] for r in C.read_back(made).collect()}
    assert got == expected(ROWS)
    text = {}
    for r in sorted(made.collect(), key=lambda r: r["chunk"]):
        text[r["conv_id"]] = text.get(r["conv_id"], "") + r["text"]
    for conv, whole in text.items():
        assert not any(c in whole for c in C.CONTROL[3:])
        assert whole.count(C.END) == got[conv][0]


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert C.read_back(C.format_conversations(none)).count() == 0


def test_escape_is_reversible():
    rng = random.Random(3)
    parts = [*C.CONTROL, "\\", "a", "<", "|", ">", "[", "/", "z", "<|", "|>", "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))
        hidden = C.escape(text)
        assert C.unescape(hidden) == text
        assert not any(c in hidden for c in C.CONTROL)


def out(source, **env):
    return "".join(x for x, _ in T.compiled(source)(env))


def test_template_language():
    assert out("a{{ x }}b", x=1) == "a1b"
    assert out("{% for i in xs %}{{ loop.index0 }}:{{ i.a }}{% if not loop.last %}, {% endif %}{% endfor %}", xs=[{"a": "p"}, {"a": "q"}]) == "0:p, 1:q"
    assert out("{% if x == 1 %}one{% elif x > 1 and x <= 3 %}few{% else %}many{% endif %}", x=2) == "few"
    assert out("{% set y = x ~ '!' %}{{ y | upper }}", x="hey") == "HEY!"
    assert out("a  {%- if true -%}  b  {%- endif -%}  c") == "abc"
    assert out("{# note #}{{ 'it\\'s' }}{{ none }}{{ d['k'][1] }}", d={"k": [1, 2]}) == "it's2"
    assert out("{{ 'a' in xs }}{{ not ('b' in 'abc') }}", xs=["a"]) == "truefalse"
    assert list(T.compiled("a{% generation %}{{ x }}{% endgeneration %}")({"x": "t"})) == [("a", False), ("t", True)]


def test_constants_are_folded():
    tree = T.simplify(T.parse("a{{ 'b' ~ ('c' | upper) }}{% if 1 + 1 == 2 %}d{{ 2 }}{% else %}{{ x }}{% endif %}e"), T.FILTERS)
    assert tree == [("text", "abCd2e")]


@pytest.mark.parametrize("source", ["{% for x in %}{% endfor %}", "{% if x %}", "{% what %}", "{{ x | nope }}", "{{ x y }}", "{{ 'a' + 1 }}", "{{ $ }}", "{{ x() }}"])
def test_bad_templates_are_refused(source):
    with pytest.raises(T.TemplateError):
        out(source, x=1)


@pytest.mark.parametrize("source", ["{{ x.__class__ }}", "{{ x['__class__'] }}", "{{ x.upper }}", "{{ xs.append }}"])
def test_python_objects_are_out_of_reach(source):
    with pytest.raises(T.TemplateError):
        out(source, x="text", xs=[1])
