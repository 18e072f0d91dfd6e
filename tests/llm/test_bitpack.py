import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from plumbline.llm import bitpack, queries
from plumbline.operators.durable import stage_path

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 31, 32])
def test_bits_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1003, dtype=np.uint64).astype("<u4")
    packed = bitpack.pack_bits(ids, bits)
    assert len(packed) == -(-1003 * bits // 8)
    assert (bitpack.unpack_bits(packed, 1003, bits) == ids).all()
    assert len(bitpack.unpack_bits(bitpack.pack_bits(ids[:0], bits), 0, bits)) == 0


def test_file_has_random_access():
    out, rng = io.BytesIO(), np.random.default_rng(0)
    writer = bitpack.IdWriter(out, 11, block=64)
    documents = [(i if i != 3 else None, rng.integers(0, 2048, n).astype("<u4")) for i, n in enumerate([5, 0, 200, 64, 1, 63])]
    for doc_id, ids in documents:
        writer.add(doc_id, ids)
    writer.close()
    reader = bitpack.IdReader(io.BytesIO(out.getvalue()), len(out.getvalue()))
    every = np.concatenate([ids for _, ids in documents])
    for start, stop in [(0, 0), (0, len(every)), (60, 70), (128, 128), (199, 333)]:
        assert (reader.ids(start, stop) == every[start:stop]).all()
    assert [(d, ids.tolist()) for d, _, ids in reader.documents()] == [(d, ids.tolist()) for d, ids in documents]
    with pytest.raises(ValueError):
        bitpack.IdWriter(io.BytesIO(), 4).add(1, np.array([16], "<u4"))
    with pytest.raises(ValueError):
        bitpack.IdReader(io.BytesIO(bytes(100)), 100)


def check(rows, wanted):
    library, start, want = Tokenizer.from_file(VOCABULARY), 0, []
    for doc_id, text in wanted:
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 2], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows), key=lambda r: r[1])
    assert got == want


def test_query_on_documents(spark, docs_dir, texts):
    check(queries.op3_bit_packed_ids(spark, docs_dir).collect(), texts)


def test_odd_rows(spark, odd, odd_rows, none):
    files = bitpack.write_ids(odd, stage_path(spark, "ids"), VOCABULARY, 49_408, 2)
    rows = bitpack.read_ids(spark, files).collect()
    got = [(r["doc_id"], zlib.crc32(r["ids"])) for r in sorted(rows, key=lambda r: r["start"])]
    assert [d for d, _ in got] == sorted((r[0] for r in odd_rows), key=lambda d: (d is not None, d))
    assert sum(f["n_docs"] for f in files) == len(odd_rows)
    assert [f["first"] for f in files] == list(np.cumsum([0, *(f["n_ids"] for f in files)])[:-1])
    assert bitpack.write_ids(none, stage_path(spark, "ids"), VOCABULARY, 49_408, 2) == []
    assert bitpack.read_ids(spark, []).count() == 0
