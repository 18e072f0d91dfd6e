"""Compare a Spark result with DuckDB's, regardless of row and column order."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

from plumbline.catalog.registry import ORACLE, QUERIES, TABLES

KINDS = {
    "int": "integer", "bigint": "bigint", "double": "double", "string": "varchar", "boolean": "boolean",
    "timestamp_ntz": "timestamp", "float": "float", "date": "date", "smallint": "smallint",
}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(x):
    if x is None or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, bool):
        return x
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, float) and x == 0:
        return 0.0
    return x


def _rows(records, columns) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in records), key=repr)


def compare(spark, con, name: str, sf_dir: str) -> list[str]:
    """Differences between the query and its SQL twin; empty when they agree."""
    df = QUERIES[name](spark, sf_dir)
    got = df.collect()
    rel = con.sql(ORACLE[name])
    want = rel.fetchall()
    problems = []
    if sorted(df.columns) != sorted(rel.columns):
        return [f"columns {sorted(df.columns)} != {sorted(rel.columns)}"]
    types = {f.name: KINDS.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    for c, t in zip(rel.columns, rel.types):
        if types[c] != str(t).lower():
            problems.append(f"type of {c}: {types[c]} != {str(t).lower()}")
    a, b = _rows(got, df.columns), _rows(want, list(rel.columns))
    if len(a) != len(b):
        problems.append(f"rows {len(a)} != {len(b)}")
    elif a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y]
        problems.append(f"{len(diff)} rows differ, e.g. {str(diff[0])[:600]}")
    return problems
