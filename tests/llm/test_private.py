import hashlib
import random
import re
import time
from array import array

import pytest

from plumbline.llm import private, queries

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def holds(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def brute(text):
    found = [(m.start(), i, m.end()) for i, (k, p) in enumerate(BASE.items()) for m in p.finditer(text) if holds(k, m.group())]
    return sorted(found)


def test_plain_spans_equal_the_patterns(texts):
    rng = random.Random(6)
    parts = ["a", "b@", "c.d", "@x.y", "1", "25", "256", "007", ".", ".4", "+", "-", " ", "(", "4111111111111111", "+49 ", "%", "é", "\n"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(20_000)]
    for text in [*made, *(t for _, t in texts)]:
        assert private.plain(text) == brute(text), text


@pytest.mark.parametrize(("text", "kind", "hidden"), [
    ("mail jo [at] mail (dot) site [dot] com now", "email", "jo [at] mail (dot) site [dot] com"),
    ("write to jo.do at site dot com please", "email", "jo.do at site dot com"),
    ("ｊｏ＠site．com x", "email", "ｊｏ＠site．com"),
    ("it is jо@sitе.com here", "email", "jо@sitе.com"),
    ("call plus four nine one five one two three four five six seven eight ok", "phone", "plus four nine one five one two three four five six seven eight"),
    ("ruf +vier neun eins fünf eins zwei drei vier fünf sechs sieben acht an", "phone",
     "+vier neun eins fünf eins zwei drei vier fünf sechs sieben acht"),
    ("host one nine two dot one six eight dot one dot seven end", "ip", "one nine two dot one six eight dot one dot seven"),
    ("card 4111​1111​1111​1111 z", "card", "4111​1111​1111​1111"),
    ("tarjeta cuatro uno uno uno uno uno uno uno uno uno uno uno uno uno uno uno fin", "card",
     "cuatro uno uno uno uno uno uno uno uno uno uno uno uno uno uno uno"),
    ("we met at noon and one two three left", None, ""),
    ("look at this dot", None, ""),
])
def test_disguises_map_back_to_the_source(text, kind, hidden):
    base, found = private.spans(text)
    assert base == []
    assert [(private.KINDS[k], text[s:e]) for s, k, e in found] == ([(kind, hidden)] if kind else [])


def test_plain_spans_stay():
    text = "a@b.cd and jo [at] site [dot] com and 4111 1111 1111 1111 and а@b.cd"
    base, found = private.spans(text)
    assert set(base) == set(brute(text)) and set(base) < set(found) and len(found) == len(base) + 1 + (brute("а@b.cd") == [])
    assert private.mask("x a@b.cd, +1 (555) 010-2030 12.") == "x [EMAIL], [PHONE]."


def row(doc_id, text):
    base = brute(text)
    names = list(BASE)
    digest = hashlib.sha256(",".join(f"{names[k]}:{s}:{e}" for s, k, e in base).encode()).hexdigest()
    return (doc_id, *(sum(k == i for _, k, _ in base) for i in range(4)), digest)


def test_query_on_documents(spark, docs_dir, texts):
    rows = queries.op7_private_data(spark, docs_dir).collect()
    assert sorted(tuple(r)[:6] for r in rows) == [row(d, t) for d, t in texts]
    known = dict(texts)
    for r in rows:
        assert r["spans"] == private.written(private.spans(known[r["doc_id"]])[1])


def test_odd_rows(odd, odd_rows, none):
    rows = private.find_private(odd).collect()
    assert sorted((tuple(r)[:6] for r in rows), key=str) == sorted((row(r[0], r[1] or "") for r in odd_rows), key=str)
    masked = private.mask_private(odd)
    assert masked.columns == odd.columns
    assert {(r["doc_id"], r["text"]) for r in masked.collect()} == {(r[0], r[1]) for r in odd_rows}
    assert private.find_private(none).count() == private.mask_private(none).count() == 0


@pytest.mark.parametrize("far", ["", " α", " x² (at) y", " we met at noon, full dot stop"])
@pytest.mark.parametrize(("text", "hidden"), [
    ("mail jo.do at site.com now", "jo.do at site.com"),
    ("mail jo.do @ site.com now", "jo.do @ site.com"),
    ("mail jo @ mail.site.com now", "jo @ mail.site.com"),
    ("mail jo@site dot com now", "jo@site dot com"),
    ("look at jo.do at site.com now", "jo.do at site.com"),
    ("look at example.com now", ""),
    ("e.g. at example.com now", ""),
])
def test_spoken_addresses_do_not_depend_on_the_rest(text, hidden, far):
    assert [text[s:e] for s, k, e in private.spans(text + far)[1] if k == 0] == [hidden] * bool(hidden)


def test_long_runs_take_linear_time():
    n = 1_000_000
    runs = ["1" * n, "1." * n, " " * n + "(", "( " * (n // 2), "@" * n, "a@" * (n // 2), "(" + " " * n, "[at]" * (n // 4), "1 " * (n // 2)]
    runs += ["one " * (n // 4) + "x", "+1" + "(" * n, "x at " + "b." * (n // 2)]
    for text in [*runs, "0" * 5000 + "1.2.3.4", "1.2.3." + "0" * 5000 + "256"]:
        start = time.process_time()
        private.spans(text)
        assert time.process_time() - start < 10, text[:20]
    assert private.written(private.plain("0" * 5000 + "1.2.3.4")) == "ip:0:5007" and private.plain("1.2.3." + "0" * 5000 + "256") == []


def test_disguises_among_very_many_plain_spans():
    text = "a@b.co " * 50_000 + "jo [at] site [dot] com " + "c@d.co " * 50_000
    base, found = private.spans(text)
    assert len(base) == 100_000 and len(found) == 100_001
    assert text[found[50_000][0] : found[50_000][2]] == "jo [at] site [dot] com"


def test_bracketed_signs_side_by_side():
    for text in ("jo (at) (x) y", "jo   (at)   site (dot) (dot) com", "x(at)y(dot)z", "   (at)   "):
        now = private.Rewritten(text, array("q", range(len(text))), array("q", range(1, len(text) + 1)))
        now = now.rewrite(private.BRACKETED, private._sign).text
        assert now == re.sub(r"\x20*\(\x20*at\x20*\)\x20*", "@", re.sub(r"\x20*\(\x20*dot\x20*\)\x20*", ".", text)), text
