import random

import numpy as np
import pytest
import xxhash

from plumbline.llm import queries, simhash
from plumbline.llm.components import smallest_reachable


def plain_fingerprint(text, k=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, budget):
    """Smallest place reachable over links, by comparing all."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= budget:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(prints))]


def clustered(n, seed):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(4)]
    out = set()
    while len(out) < n:
        x = rng.choice(centres) if rng.random() < 0.7 else rng.getrandbits(64)
        for _ in range(rng.randint(0, 5)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return sorted(out | {0, 1, (1 << 64) - 1})


def test_trie_links_are_all_links():
    values = np.array(clustered(700, 1), np.uint64)
    for budget in (0, 1, 2, 4):
        near = np.bitwise_count(values[:, None] ^ values[None, :]) <= budget
        got = {(int(i), int(j)) for a, b in simhash.trie_links(values, values, budget, True) for i, j in zip(a, b)}
        assert got == {(i, j) for i, j in zip(*map(list, np.nonzero(np.triu(near, 1))))}
        left, right = values[::2].copy(), values[1::3].copy()
        near = np.bitwise_count(left[:, None] ^ right[None, :]) <= budget
        found = [(int(i), int(j)) for a, b in simhash.trie_links(left, right, budget, False) for i, j in zip(a, b)]
        assert len(found) == len(set(found)) and set(found) == set(zip(*map(list, np.nonzero(near))))


def test_trie_links_that_agree_in_a_block():
    values = np.array(clustered(500, 4), np.uint64)
    far = values[:, None] ^ values[None, :]
    want = np.triu((np.bitwise_count(far) <= 3) & (far >> np.uint64(54) == 0), 1)
    got = {(int(i), int(j)) for a, b in simhash.trie_links(values, values, 3, True, 10) for i, j in zip(a, b)}
    assert got == set(zip(*map(list, np.nonzero(want))))


def test_rotation_goes_round():
    x = np.array([1, 1 << 63, 0x0123456789ABCDEF], np.uint64)
    assert simhash.rotated(x, 4).tolist() == [16, 8, 0x123456789ABCDEF0]
    for by in (0, 1, 21, 63, 64):
        assert (simhash.rotated(simhash.rotated(x, by), 64 - by) == x).all()


@pytest.mark.parametrize("budget", [0, 1, 2, 4])
def test_forest_over_many_leaves(spark, monkeypatch, budget):
    """A hot prefix is cut deeper; the result does not depend on the cuts."""
    monkeypatch.setattr(simhash, "LEAF", 40)
    values = clustered(900, 2)
    table = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "fp bigint")
    edges = simhash.link_forest(table, len(values), budget).collect()
    got = {frozenset((r["a"], r["b"])) for r in edges}
    root = {}
    for v, c in zip(values, plain_components(values, budget)):
        root[int(np.uint64(v).view(np.int64))] = c
    parent = {}

    def find(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for a, b in map(tuple, got):
        assert root[a] == root[b]
        parent[find(a)] = find(b)
    assert len({find(x) for x in root}) == len(set(root.values()))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 300)] + [(7, 7), (2000, 2001), (2001, 2000)]
    rows = smallest_reachable(spark.createDataFrame(edges, "a bigint, b bigint").repartition(5)).collect()
    got = {r["node"]: r["root"] for r in rows}
    assert got == {**{i: 0 for i in range(1, 61)}, **{1000 + i: 1000 for i in range(1, 300)}, 2001: 2000}
    assert smallest_reachable(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_query_on_documents(spark, docs_dir, texts):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op5_simhash_components(spark, docs_dir).collect()}
    prints = [plain_fingerprint(t) for _, t in texts]
    roots = plain_components(prints, 2)
    assert got == {d: (f"{p:016x}", texts[r][0]) for (d, _), p, r in zip(texts, prints, roots)}


def test_odd_rows(odd, odd_rows, none):
    rows = simhash.components(odd).collect()
    assert len(rows) == len(odd_rows)
    found = {r["doc_id"]: r["component_id"] for r in rows}
    assert found[1] == found[2] == found[3] == 1 and found[5] == 0 and found[10] == 7 and found[4] == 4 and found[None] is None
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([0, 1, 4, 6, 7, 8, 9, None], key=str)
    assert simhash.components(none).count() == simhash.keep_one(none).count() == 0
    long_text = "x y " * 40_000
    assert simhash.fingerprint(long_text) == plain_fingerprint(long_text)
