import hashlib
import random

from plumbline.llm import bloomdiff, queries
from plumbline.llm.bloomdiff import Sketch


def test_peeling_recovers_the_differing_digests():
    rng = random.Random(1)
    for n_common, n_a, n_b in [(0, 0, 0), (50, 3, 4), (500, 10, 0), (5, 0, 12)]:
        common, a, b = ([rng.getrandbits(64) for _ in range(n)] for n in (n_common, n_a, n_b))
        only = bloomdiff.difference(Sketch.of(common + a), Sketch.of(b + common))
        assert only is not None and set(only[0]) == set(a) and set(only[1]) == set(b)


def test_a_stuck_sketch_says_so_and_a_larger_one_recovers():
    rng = random.Random(2)
    a, b = ([rng.getrandbits(64) for _ in range(400)] for _ in range(2))
    both = a[:100] + b
    assert bloomdiff.difference(Sketch.of(a), Sketch.of(both)) is None
    assert bloomdiff.likeness(Sketch.of(a), Sketch.of(both)) is None
    sizes = []

    def larger(size):
        sizes.append(size)
        return Sketch.of(a, size), Sketch.of(both, size)

    assert bloomdiff.likeness(Sketch.of(a), Sketch.of(both), larger) == 100 / 800
    assert sizes == sorted(sizes) and sizes[-1] > 200


def test_beyond_the_largest_sketch_the_likeness_is_exact(monkeypatch):
    monkeypatch.setattr(bloomdiff, "LARGEST", 32)
    a, b = ("\n".join(f"{kind} {i}" for i in range(2000)) for kind in "xy")
    one, other = bloomdiff.Document(1, a), bloomdiff.Document(2, a + "\n" + b)
    assert one.like(other) == other.like(one) == 0.5 and one.like(bloomdiff.Document(3, b)) == 0.0


def test_fingerprint_is_the_sketch():
    sketch = Sketch.of(bloomdiff.digests("One two. Three four!\nFive. Five. Five."))
    again = Sketch.read(sketch.text())
    assert (again.size, again.total, again.counts, again.sums) == (sketch.size, sketch.total, sketch.counts, sketch.sums)
    assert bloomdiff.likeness(again, sketch) == 1.0


def test_paragraphs():
    long = " ".join(f"w{i}" for i in range(100))
    assert len(bloomdiff.digests(long)) == 7  # runs of 16 words
    text = f"A b c. D e f?\nG h.\n{long}"
    assert len(bloomdiff.digests(text)) == 3 + 7
    assert set(bloomdiff.digests(f"D e f?\n{long}")) < set(bloomdiff.digests(text))
    assert len(bloomdiff.digests("x x")) == 3 and bloomdiff.digests("") == bloomdiff.digests(" \n ") == []


def likeness_of(a, b):
    a, b = set(bloomdiff.digests(a)), set(bloomdiff.digests(b))
    return len(a & b) / len(a | b) if a | b else 1.0


def check(rows, ordered):
    assert len(rows) == len(ordered)
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append(r)
    for i, (doc_id, text) in enumerate(ordered):
        following = ordered[(i + 1) % len(ordered)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + following[:cut]
        want = (len(text), hashlib.sha256(edited.encode()).hexdigest(), likeness_of(text, edited), likeness_of(text, following))
        found = [(r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in got[doc_id]]
        assert want in found
        assert all(r["fingerprint"] == Sketch.of(bloomdiff.digests(text)).text() for r in got[doc_id] if len(got[doc_id]) == 1)
        assert Sketch.of(bloomdiff.digests(edited)).text() in [r["edited_fingerprint"] for r in got[doc_id]]


def test_query_on_documents(spark, docs_dir, texts):
    rows = queries.op10_document_fingerprints(spark, docs_dir).collect()
    check(rows, texts)
    assert sum(r["near_edited"] > r["near_next"] for r in rows) > 0.97 * len(rows)


def test_odd_rows(spark, odd, odd_rows, none):
    unique = [(r[0], r[1] or "") for r in odd_rows]
    ordered = sorted(unique, key=lambda r: (r[0] is not None, r[0]))
    for pieces in ("1", "8"):
        check(bloomdiff.fingerprints(odd).collect(), ordered)
        spark.conf.set("spark.sql.shuffle.partitions", pieces)
    assert bloomdiff.fingerprints(none).count() == 0
    check(bloomdiff.fingerprints(odd.filter("doc_id = 0")).collect(), [r for r in ordered if r[0] == 0])
