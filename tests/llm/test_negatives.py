import random

import duckdb
import numpy as np
import pytest

from plumbline.llm import negatives, queries
from plumbline.llm.negatives import LARGEST, Residues


@pytest.mark.parametrize("largest", [0, 1, 300, 1 << 20, 1 << 29, 1 << 40, LARGEST])
def test_products_are_exact(largest):
    rng = np.random.default_rng(largest % 97)
    for n, m, dims in [(3, 5, 1), (4, 7, 64), (2, 3, 2500), (1, 1, 0), (0, 4, 3)]:
        a, b = (rng.integers(-largest, largest, (k, dims), endpoint=True) for k in (n, m))
        if dims:
            a[:1], b[:1] = largest, -largest  # the largest possible score
        want = [[min(max(sum(int(x) * int(y) for x, y in zip(p, q)), -LARGEST), LARGEST) for q in b] for p in a]
        got = negatives.product(Residues(a), Residues(b))
        assert got.dtype == np.int64 and got.tolist() == want


def test_primes_are_the_odd_ones_below_256():
    assert negatives.PRIMES[:3] == [251, 241, 239] and negatives.PRIMES[-1] == 3 and len(negatives.PRIMES) == 53


def test_best_of_each_row_with_ties():
    rng = np.random.default_rng(2)
    for n, most in [(1, 3), (7, 3), (40, 2), (40, LARGEST)]:
        scores = rng.integers(-most, most, (6, n), endpoint=True)
        allowed = rng.random((6, n)) < 0.6
        allowed[0] = False
        rows, columns = negatives.best(scores, allowed, 4)
        want = [(i, j) for i in range(6) for j in sorted(np.flatnonzero(allowed[i]), key=lambda j: (-int(scores[i, j]), j))[:4]]
        assert list(zip(rows.tolist(), columns.tolist())) == [(i, int(j)) for i, j in want]


def brute(rows, every, share=(80, 100), n_positives=5, n_negatives=5):
    """rows: (vec_id, label, whole components) of usable rows."""
    def order(s):
        return -s[0], s[1] is None, s[1] or 0

    def score(v, w):
        return min(max(sum(a * b for a, b in zip(v, w)), -LARGEST), LARGEST)

    out = []
    for anchor, label, v in rows:
        if anchor is not None and anchor % every == 0:
            same, other = ([(score(v, w), i) for i, x, w in rows if i != anchor and (x == label) == s] for s in (True, False))
            for p, positive in sorted(same, key=order)[:n_positives]:
                window = sorted((s for s in other if share[0] * p <= share[1] * s[0] <= share[1] * p), key=order)[:n_negatives]
                out += [(anchor, positive, n + 1, i, p, s) for n, (s, i) in enumerate(window)]
    return sorted(out, key=str)


def got(df):
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, df.collect()), key=str)


def whole(v):
    return [int(np.floor(256 * float(x))) for x in v]


@pytest.mark.parametrize("components", [1 << 19, 600])
def test_query_equals_sql(spark, docs_dir, components, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK_COMPONENTS", components)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{docs_dir}/embeddings.parquet'")
    want = con.sql(queries.ORACLE["op11_hard_negatives"]).fetchall()
    assert len(want) > 50 and got(queries.op11_hard_negatives(spark, docs_dir)) == sorted(want, key=str)


def test_ties_copies_and_a_hot_label_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK_COMPONENTS", 130)
    monkeypatch.setattr(negatives, "ANCHORS", 3)
    rng = random.Random(3)
    rows = [(i, rng.choice([0, 0, 0, 1, 2, -5]), [rng.choice([0.0, 0.25, 0.5]) for _ in range(4)]) for i in range(260)]
    rows += [(1000 + i, 7, [0.5] * 4) for i in range(90)] + rows[:30] + [(None, 0, [0.5] * 4), (None, 1, [0.5] * 4)]
    table = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>").repartition(4)
    assert got(negatives.mine(table, every=10)) == brute([(i, x, whole(v)) for i, x, v in rows], 10)
    assert got(negatives.mine(table, every=10, positives=2, negatives=9, share=(1, 2))) == brute([(i, x, whole(v)) for i, x, v in rows], 10, (1, 2), 2, 9)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, 1, [0.5, -0.5]), (1, 1, None), (2, None, [0.5, -0.5]), (3, 1, [nan, 1.0]), (4, 1, [inf, 0.0]), (5, 1, [None, 1.0]),
        (6, 1, [0.5]), (7, 2, [0.45, -0.5, 9.0]), (7, 2, [0.45, -0.5, 9.0]), (8, 1, []), (None, 2, [0.45, -0.5]), (10, 2, [0.4, -0.4]),
        (10, 1, [0.4, -0.4]), (11, 2, [0.5, -0.5]), (-20, 1, [0.5, -0.45]),
    ]
    kinds = "vec_id bigint, label int, embedding array<double>"
    table = spark.createDataFrame(rows, kinds).selectExpr("*", "1 AS block", "2 AS at", "'x' AS positives", "true AS asks")
    kept = [(i, x, whole(v)) for i, x, v in rows if i not in (1, 2, 3, 4, 5)]
    assert got(negatives.mine(table, every=10)) == brute(kept, 10) != []
    assert negatives.mine(table.filter("false")).count() == negatives.mine(table.filter("vec_id = 0")).count() == 0
    big = [(0, 1, [3e16, 1.0]), (1, 1, [3e16, 3.0]), (2, 2, [3e16, 0.0]), (3, 2, [-3e16, 0.0]), (4, 1, [1e10, 0.0]), (5, 2, [9e9, 0.0])]
    assert got(negatives.mine(spark.createDataFrame(big, kinds), every=10)) == brute([(i, x, whole(v)) for i, x, v in big], 10) != []
