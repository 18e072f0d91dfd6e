import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken

from plumbline.llm import bytebpe, queries

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def ranks():
    return bytebpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def ours():
    return bytebpe.TextEncoder(PATH, PATTERN)


def made(rng, n):
    parts = [
        "a", "b", "the", "ing", " ", "  ", "\n", "\t", "'s", "'", "é", "日", "本", "🎉", "12", "0", "\x00", "\x1c", "\x85", " ",
        "=", "==", "----", "zz", "tion", "ß", "﷽", "‍", "<|endoftext|>", "A", "THE", ".", ",\n", "//",
    ]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def test_texts_equal_the_library(library, ours, texts):
    every = [*made(random.Random(3), 8000), *(t for _, t in texts), *(" " * n + "x" for n in range(140)), "ab" * 3000, "=" * 5000, "日" * 700]
    for text, ids in zip(every, ours.encode_all(every).to_pylist()):
        assert ids == library.encode_ordinary(text), repr(text[:80])


@pytest.mark.parametrize("alphabet", [b"ab", b" \n", b"=-", bytes(range(256)), "éèüß日本".encode()])
def test_any_bytes_equal_plain_merging(ours, ranks, alphabet):
    """Also bytes that no text has; the whole is one token if it is in the vocabulary."""
    rng = random.Random(5)
    for _ in range(600):
        raw = bytes(rng.choice(alphabet) for _ in range(rng.randint(1, 60)))
        parts, _ = ours.merges.merge(raw.decode("latin-1"))
        want = [ranks[raw]] if raw in ranks else [ours.merges.id[p] for p in parts]
        assert ours.merges.encode(raw) == want, raw


def test_small_vocabularies_with_ties_and_unreachable_tokens():
    """Random merges, some tokens that no merge makes, and overlapping repeats."""
    for seed in range(150):
        rng = random.Random(seed)
        tokens = [bytes([b]) for b in range(256)]
        for _ in range(rng.randint(1, 12)):
            new = rng.choice(tokens[97:]) + rng.choice([t for t in tokens if set(t) <= set(b"abc")])
            if set(new) <= set(b"abc") and new not in tokens:
                tokens.append(new)
        for _ in range(8):
            a, b = (rng.choice([t for t in tokens if set(t) <= set(b"abc")]) for _ in range(2))
            if a + b not in tokens:
                tokens.append(a + b)
        odd = bytes(rng.choice(b"abc") for _ in range(5))
        tokens += [odd] * (odd not in tokens)
        ranks = {t: i for i, t in enumerate(tokens)}
        one = bytebpe.Merges(ranks)
        library = tiktoken.Encoding(f"own{seed}", pat_str="[abc]+", mergeable_ranks=ranks, special_tokens={})
        for _ in range(40):
            text = "".join(rng.choice("abc") for _ in range(rng.randint(1, 30)))
            assert one.encode(text.encode()) == library.encode_ordinary(text), (seed, text)


def test_pairs_stay_apart_as_merging_says(ours):
    rng, merges = random.Random(6), ours.merges
    for _ in range(6000):
        a, b = rng.randrange(merges.size), rng.choice([rng.randrange(merges.size), rng.randrange(256)])
        parts, _ = merges.merge(merges.letters[a] + merges.letters[b])
        assert merges.fits(a, b) == (parts == [merges.letters[a], merges.letters[b]])


def test_long_matches_take_linear_time(ours):
    rng = random.Random(7)
    word = "".join(rng.choice("abcdefgh") for _ in range(200_000))
    calls = []
    shorter = ours.merges.shorter
    ours.merges.shorter = lambda token: calls.append(1) or shorter(token)
    try:
        ids = ours.merges.encode(word.encode())
    finally:
        del ours.merges.shorter
    assert b"".join(ours.merges.letters[i].encode() for i in ids) == word.encode() and len(calls) < 4 * len(word)


def test_few_kept_matches_change_nothing(ours, texts, monkeypatch):
    monkeypatch.setattr(bytebpe, "KEPT_MATCHES", 7)
    monkeypatch.setattr(bytebpe, "KEPT_PAIRS", 5)
    some = [t for _, t in texts[:30]]
    assert bytebpe.TextEncoder(PATH, PATTERN).encode_all(some) == ours.encode_all(some)


def test_query_on_documents(spark, docs_dir, texts, library):
    def digest(raw):
        return hashlib.sha256(raw).hexdigest()

    want = []
    for d, t in texts:
        ids = [i for m in regex.findall(PATTERN, t) for i in library._encode_single_piece(m.encode())]
        assert ids == library.encode_ordinary(t)
        want.append((d, len(ids), digest(" ".join(map(str, ids)).encode()), digest(library.decode_bytes(ids))))
    rows = queries.op12_byte_bpe(spark, docs_dir).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert sorted(map(tuple, rows.collect())) == want


def test_odd_rows(spark, odd, odd_rows, library, none):
    rows = bytebpe.decode(bytebpe.encode(odd, PATH, PATTERN), PATH).collect()
    want = [(d, library.encode_ordinary(t or ""), (t or "").encode()) for d, t, *_ in odd_rows]
    assert sorted(((r["doc_id"], r["ids"], bytes(r["decoded"])) for r in rows), key=str) == sorted(want, key=str)
    assert bytebpe.decode(bytebpe.encode(none, PATH, PATTERN), PATH).count() == 0
    given = spark.createDataFrame([(1, None, "x"), (2, [], "y"), (3, [220, 255], "z")], "k int, ids array<int>, decoded_from string")
    got = {r["k"]: (r["decoded"], r["decoded_from"]) for r in bytebpe.decode(given, PATH).collect()}
    assert got[1] == (None, "x") and got[2] == (b"", "y") and got[3][0] == library.decode_bytes([220, 255])


def test_ids_fill_arrow_offsets():
    one = bytebpe.Decoder({bytes([b]): b for b in range(256)} | {b"abc": 256})
    assert one.decode_all(np.array([97, 256, 98], "<i4"), np.array([0, 0, 2, 3])).to_pylist() == [b"", b"aabc", b"b"]
