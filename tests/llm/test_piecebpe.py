import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from plumbline.llm import piecebpe, queries

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def ours():
    return piecebpe.PartEncoder(MODEL)


def test_texts_equal_the_library(library, ours, texts):
    rng = random.Random(3)
    parts = [
        "a", "b", "e", "th", "▁", " ", "  ", "   ", "\n", "\t", "é", "日", "本", "🎉", "the", "ing", " in", "000", "1", "_", "=", "==",
        "====", "            ", "<s>", "<0x41>", "İ", "ﬁ", "\x00", "zz", "ion", "ー", "​",
    ]
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(6000)]
    made += [" " * n + "x" for n in range(70)] + [" " * n for n in range(70)] + ["ab" * 3000, "=" * 3000, "日" * 500]
    for text in [*made, *(t for _, t in texts)]:
        want = library.encode(text, add_bos=True, add_eos=True)
        got = ours.encode(text)
        assert np.frombuffer(got, "<u4").tolist() == want, repr(text[:80])
        assert ours.decode(got) == library.decode(want)


def test_any_ids_decode_like_the_library(library, ours):
    rng = random.Random(4)
    for _ in range(5000):
        ids = [rng.choice([rng.randrange(32_000), rng.randrange(259), library.piece_to_id("▁"), 259]) for _ in range(rng.randint(0, 8))]
        assert ours.model.decode(ids) == library.decode(ids), ids


def test_compatibility_equals_merging_anew(ours):
    rng, model = random.Random(5), ours.model
    tokens = [t for t in model.rank if model.usable(t) and not (model.piece[t].strip("▁") == "" and model.length[t] > 1)]
    for _ in range(4000):
        a, b = rng.choice(tokens), rng.choice(tokens)
        if model.piece[b][0] != "▁":
            merged = [p for p, _, _ in model.merge(model.piece[a] + model.piece[b])]
            assert model.compatible(a, b) == (merged == [model.piece[a], model.piece[b]])


def test_query_on_documents(spark, docs_dir, texts, library):
    def digest(raw):
        return hashlib.sha256(raw).hexdigest()

    want = []
    for d, t in texts:
        ids = library.encode(t, add_bos=True, add_eos=True)
        want.append((d, len(ids), digest(np.array(ids, "<u4").tobytes()), digest(library.decode(ids).encode())))
    assert sorted(map(tuple, queries.op8_sentencepiece(spark, docs_dir).collect())) == want


def test_odd_rows(odd, odd_rows, library, none):
    rows = piecebpe.decode(piecebpe.encode(odd, MODEL), MODEL).collect()
    want = []
    for doc_id, text, *_ in odd_rows:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        want.append((doc_id, np.array(ids, "<u4").tobytes(), library.decode(ids)))
    assert sorted(((r["doc_id"], bytes(r["ids"]), r["decoded"]) for r in rows), key=str) == sorted(want, key=str)
    assert piecebpe.decode(piecebpe.encode(none, MODEL), MODEL).count() == 0
