import hashlib
import random
import zlib

import duckdb
import pytest

from plumbline.llm import prefixtrie, queries

NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def paths_of(rows, every=100, longest=6):
    """conv_id -> rebuilt turns, from (conv_id, turn, role, text); equal turns only in equal rows."""
    own = {}
    for c, _, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1])):
        own.setdefault(c, []).append((role or "", text or ""))
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % longest
        donor = c - (abs(c) % every if c >= 0 else -(abs(c) % every))
        out[c] = own.get(donor, [])[:h] + turns[h:]
    return out


def brute(paths):
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
    children = {p: [] for p in members}
    for p in members:
        if p:
            children[p[:-1]].append(p)

    def below(p):
        found, todo = [], [p]
        while todo:
            found.append(todo.pop())
            todo += children[found[-1]]
        return found

    out = []
    for p, who in members.items():
        tree = below(p)
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in tree if q)
        ends = ",".join(map(str, sorted(c for c in who if len(paths[c]) == len(p))))
        out.append((
            min(who), len(p), min(members[p[:-1]]) if p else None, len(who), len(children[p]), sum(not children[q] for q in tree), saved,
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.select(*NAMES).collect()), key=repr)


def test_query_equals_sql_and_plain_python(spark, docs_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{docs_dir}/conversations.parquet'")
    found = queries.op13_prefix_trie(spark, docs_dir)
    assert found.columns == NAMES
    want = con.sql(queries.ORACLE["op13_prefix_trie"])
    rows = spark.read.parquet(f"{docs_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert got(found) == sorted(want.select(*NAMES).fetchall(), key=repr) == brute(paths_of([tuple(r) for r in rows]))


def made(rng):
    """Copies, shared beginnings, a hot first turn, long conversations, absent donors, negative ids."""
    said = [("user", "é🎉"), ("user", "hi"), ("assistant", "hi"), ("", "hi"), ("user", ""), ("us", "erhi")]
    rows = []
    for c in [*range(-130, 260, 3), *range(400, 460), 1000, 1001]:
        n = rng.choice([1, 2, 3, 7, 8, 9, 16, 17, 40]) if c % 5 else 12
        rows += [(c, t, *(said[1] if t == 0 or c % 5 == 0 else rng.choice(said[: 2 + c % 5]))) for t in range(n)]
    return rows


@pytest.mark.parametrize(("width", "run", "ids", "hot"), [(8, 1024, 1 << 16, None), (3, 2, 2, 40), (1, 3, 5, 30)])
def test_blocks_runs_and_hot_keys(spark, width, run, ids, hot, monkeypatch):
    for name, value in (("WIDTH", width), ("RUN", run), ("IDS", ids)):
        monkeypatch.setattr(prefixtrie, name, value)
    if hot:
        whole = prefixtrie.hot_keys
        sliced = []
        monkeypatch.setattr(prefixtrie, "hot_keys", lambda df, keys: sliced.append(whole(df, keys, hot)) or sliced[-1])
    rows = made(random.Random(4))
    rows += [(2000, t, "user", f"long {t % 7}") for t in range(300)]
    table = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").repartition(5)
    assert got(prefixtrie.trie(*prefixtrie.with_heads(table))) == brute(paths_of(rows))
    assert not hot or any(s is not None for s in sliced)


def test_odd_rows(spark):
    rows = [
        (1, None, None, None), (1, 0, "user", "x"), (1, 0, "user", "x"), (2, 0, "user", None), (100, 1, "user", "a"), (100, None, "user", "b"),
        (101, 0, "user", "c"), (None, 0, "user", "lost"), (None, 0, "user", "lost"), (3, 0, "user", "z" * 300_000), (4, 0, "user", "z" * 300_000),
    ]
    kinds = "conv_id bigint, turn int, role string, text string"
    table = spark.createDataFrame(rows, kinds).selectExpr("*", "1 AS at", "2 AS first", "'x' AS id", "3 AS __slice", "4 AS position")
    want = brute(paths_of(rows))
    assert got(prefixtrie.trie(*prefixtrie.with_heads(table))) == want and any(r[1] == 0 for r in want)
    assert prefixtrie.trie(*prefixtrie.with_heads(table.filter("false"))).count() == 0
    assert prefixtrie.trie(*prefixtrie.with_heads(table.filter("conv_id IS NULL"))).count() == 0


def test_other_turns_and_the_ids_of_nodes(spark):
    turns = spark.createDataFrame([(7, 1, b"a", 5), (7, 2, b"b", 6), (9, 1, b"a", 5)], "conv_id bigint, position bigint, id binary, length bigint")
    convs = spark.createDataFrame([(7, 2), (9, 1), (11, 0)], "conv_id bigint, n_turns bigint")
    rows = {r["depth"]: r for r in prefixtrie.trie(turns, convs).collect()}
    assert [(rows[d]["turn_id"], rows[d]["length"], rows[d]["n_convs"], rows[d]["saved_tokens"]) for d in range(3)] == [
        (None, 0, 3, 5), (b"a", 5, 2, 5), (b"b", 6, 1, 0),
    ]
    assert [rows[d]["n_leaves"] for d in range(3)] == [1, 1, 1] and rows[1]["parent_conv_id"] == 7
    assert rows[0]["ends_sha256"] == hashlib.sha256(b"11").hexdigest()
