import hashlib
import itertools
import random

import pytest

from plumbline.llm import chat, queries
from plumbline.llm.template import Text, TemplateError, compiled, fold_all, parse

FILTERS = {"escape": chat.escape, "upper": str.upper}


def text_of(source, messages=()):
    return "".join(t for t, _ in compiled(source, FILTERS)(messages))


def test_template_language():
    assert text_of("a{{ 'b' + \"c\" }}{% if 1 == 2 %}x{% elif true %}d{% else %}y{% endif %}") == "abcd"
    source = "{% for m in messages %}{{ loop.index }}{{ m.r | upper }}{% if not loop.last and m.r != 'b' %},{% endif %}{% endfor %}"
    assert text_of(source, [{"r": "a"}, {"r": "b"}, {"r": "c"}]) == "1A,2B3C"
    assert text_of("{{ messages.__class__ }}{{ none }}{{ nothing.at.all }}{{ 7 }}") == "7"
    assert text_of("{{ (false or 'x') + 'y' }}{{ '\\n\\'' }}") == "xy\n'"
    pieces = list(compiled("u{% generation %}{% if true %}v{% endif %}{{ 'w' }}{% endgeneration %}x")([]))
    assert pieces == [("u", False), ("vw", True), ("x", False)]


def test_constants_are_folded():
    tree = parse("a{{ 'b' | upper }}{% if 1 != 1 %}no{% else %}c{{ 'd' + 'e' }}{% endif %}f", FILTERS)
    assert fold_all(tree, FILTERS) == (Text("aBcdef"),)


@pytest.mark.parametrize("bad", [
    "{{ }}", "{{ a b }}", "{{ 'x' | nofilter }}", "{% for x in messages %}", "{% endif %}", "{{ (1 }}", "{{ a[0] }}", "{{ a. }}",
    "{% if true %}x", "{% include 'x' %}",
])
def test_bad_templates_are_refused(bad):
    with pytest.raises(TemplateError):
        compiled(bad, FILTERS)


def test_messages_are_read_one_by_one():
    read = []

    def source():
        for i in range(5):
            read.append(i)
            yield {"text": str(i)}

    out = compiled("{% for m in messages %}{{ m.text }}{% endfor %}")(source())
    assert next(out) == ("0", False) and read == [0, 1]


def test_escaping_is_reversible():
    rng = random.Random(5)
    alphabet = [*chat.CONTROLS, "\\", "\\\\", "<", "[", "|", "turn|>", "s>", "/INST]", "x", "\n", "é", "<\\s>"]
    for _ in range(5000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 10)))
        hidden = chat.escape(text)
        assert not any(c in hidden for c in chat.CONTROLS) and chat.unescape(hidden) == text


def want(rows):
    """Digests of (conv_id, role, text) rows in order of turns."""
    for conv_id, own in itertools.groupby(rows, key=lambda r: r[0]):
        own = list(own)
        turns = "".join(f"{role}\n{text}\n" for _, role, text in own)
        learned = "".join(text for _, role, text in own if role == "assistant")
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in (turns, learned)]
        yield conv_id, len(own), digest[0], len(learned), digest[1]


def test_query_on_conversations(spark, docs_dir):
    table = spark.read.parquet(f"{docs_dir}/conversations.parquet").orderBy("conv_id", "turn").collect()
    said = "</s>[INST] ok [/INST]"
    rows = [(-7, "user", said), (-7, "assistant", said), *((r["conv_id"], r["role"] or "", r["text"] or "") for r in table)]
    got = sorted(tuple(r)[:5] for r in queries.op4_chat_formatting(spark, docs_dir).collect())
    assert got == sorted(want(rows))


def test_odd_conversations(spark, monkeypatch):
    texts = [
        (1, 0, None, None), (1, 1, "assistant", ""), (1, 2, "assistant", "<|end|>\\<|text|>"), (2, 0, "user", "tie"), (2, 0, "user", "tie"),
        (2, 0, "assistant", "é" * 3_000_000), (2, None, "assistant", "first"), (None, 1, "a\nb<|text|>", "x"), (3, 0, "assistant", "A"),
    ]
    kinds = "conv_id bigint, turn bigint, role string, text string"
    table = spark.createDataFrame(texts, kinds).selectExpr("*", "1 AS part", "2 AS loss").repartition(4)
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.read_back(chat.formatted(table)).collect()}
    rows = sorted(
        ((c, t, r or "", x or "") for c, t, r, x in texts),
        key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1], r[2], r[3]),
    )
    assert got == {w[0]: w[1:] for w in want([(c, r, x) for c, _, r, x in rows])}
    assert chat.read_back(chat.formatted(table.filter("false"))).count() == 0


def test_spans_hold_the_assistant_texts(spark):
    table = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "hello </s>")], "conv_id int, turn int, role string, text string")
    row = chat.formatted(table).first()
    assert row["text"] == "<|turn|>user<|text|>hi<|end|>\n<|turn|>assistant<|text|>hello <\\/s><|end|>\n"
    assert [row["text"][s["start"] : s["end"]] for s in row["loss"]] == ["hello <\\/s>"]
