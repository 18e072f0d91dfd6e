import random

import duckdb
import numpy as np

from plumbline.llm import impact, queries


def brute(rows, k, every):
    """rows: (vec_id, whole components)."""
    out = []
    for query_id, q in rows:
        if query_id is not None and query_id % every == 0:
            scored = []
            for i, v in rows:
                if i != query_id:
                    score = sum(a * b for a, b in zip(q, v))
                    scored.append((-min(max(score, -(2**63)), 2**63 - 1), i is None, i or 0, i))
            scored.sort(key=lambda s: s[:3])
            out += [(query_id, n + 1, s[3], -s[0]) for n, s in enumerate(scored[:k])]
    return sorted(out, key=lambda r: r[:2])


def got(df):
    return sorted(((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect()), key=lambda r: r[:2])


def test_query_equals_sql(spark, docs_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{docs_dir}/embeddings.parquet'")
    want = con.sql(queries.ORACLE["op6_impact_top_k"]).fetchall()
    assert got(queries.op6_impact_top_k(spark, docs_dir)) == sorted(want)


def test_blocks_and_ties(spark, monkeypatch):
    monkeypatch.setattr(impact, "BLOCK", 40)
    monkeypatch.setattr(impact, "QUERIES", 3)
    rng = random.Random(3)
    vectors = [(i, [rng.choice([-0.5, 0.0, 0.25, 0.5]) for _ in range(6)]) for i in range(200)]
    vectors += [(1000 + i, [0.25] * 6) for i in range(150)]
    table = spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>").repartition(4)
    whole = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in vectors]
    assert got(impact.top_k(table, 7, 20)) == brute(whole, 7, 20)


def test_odd_vectors(spark):
    rows = [
        (0, [0.5, -0.5]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (5, []), (6, [0.5]),
        (7, [0.1, 0.2, 0.3]), (7, [0.1, 0.2, 0.3]), (None, [0.5, -0.5]), (10, [0.1, 0.1]),
    ]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "1 AS block", "2 AS queries")
    whole = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if i in (0, 5, 6, 7, None, 10)]
    assert got(impact.top_k(table, 10, 10)) == brute(whole, 10, 10)
    assert impact.top_k(table.filter("false")).count() == 0
    big = spark.createDataFrame([(0, [1e15, 1.0]), (1, [1e15, 3.0]), (2, [-1e15, 0.0])], "vec_id bigint, embedding array<double>")
    assert got(impact.top_k(big, 10, 10)) == [(0, 1, 1, 2**63 - 1), (0, 2, 2, -(2**63))]


def test_index_stops_on_proof_only():
    """Random blocks: the rows given are exactly scored and hold the k best with all ties."""
    rng = np.random.default_rng(1)
    for n, dims in [(1, 3), (50, 1), (500, 8), (800, 24)]:
        vectors = rng.integers(-700, 700, (n, dims))
        index = impact.ImpactIndex(vectors)
        for _ in range(20):
            query = rng.integers(-700, 700, dims)
            allowed = rng.random(n) < 0.9
            rows, scores = index.top(query, allowed, 10)
            exact = vectors @ query
            assert (scores == exact[rows]).all() and allowed[rows].all()
            best = np.sort(exact[allowed])[::-1][:10]
            assert set(np.flatnonzero(allowed & (exact >= (best[-1] if len(best) else 0)))) <= set(rows)
