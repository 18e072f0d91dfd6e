import random
import zlib

import numpy as np
import pytest

from plumbline.llm import queries, sharding


def jump(key, shards):
    """The published function, one key at a time."""
    b, j = -1, 0
    while j < shards:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_equals_the_published_function():
    rng = random.Random(1)
    keys = [0, 1, 2**64 - 1, *(rng.randrange(2**64) for _ in range(2000))]
    for shards in (1, 2, 16, 17, 1000):
        got = sharding.jump_hash(np.array(keys, np.uint64), shards)
        assert got.tolist() == [jump(k, shards) for k in keys]


def test_query_on_documents(spark, docs_dir, texts):
    rows = queries.op2_sharding(spark, docs_dir).collect()
    known = dict(texts)
    assert sorted(r["doc_id"] for r in rows) == [d for d, _ in texts]
    for r in rows:
        raw = known[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert r["grown_shard"] in (r["shard"], 16)
    check_slots(rows, 16)


def check_slots(rows, shards):
    for s in range(shards):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_shard_depends_on_the_key_alone(docs):
    first = {r["doc_id"]: r["shard"] for r in sharding.shard(docs, shards=5).collect()}
    part = sharding.shard(docs.filter("doc_id % 3 = 0").repartition(7), shards=5).collect()
    assert all(first[r["doc_id"]] == r["shard"] for r in part)


def test_odd_rows(odd, odd_rows, none):
    found = sharding.shard(odd, "doc_id", 3)
    rows = found.collect()
    assert len(rows) == len(odd_rows) and "fp" in found.columns and found.columns.count("shard") == 1
    check_slots(rows, 3)
    assert len({r["shard"] for r in rows if r["doc_id"] == 4}) == 1
    assert sharding.shard(none, "doc_id", 3).count() == 0
    assert {r["shard"] for r in sharding.shard(odd, "text", 1).collect()} == {0}
    with pytest.raises(ValueError):
        sharding.shard(odd, "doc_id", 0)
