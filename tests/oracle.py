"""Comparison of a query with its SQL in DuckDB."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 5) + 0.0
    return v


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(_plain(r[k]) for k in order) for r in rows), key=repr)


def check(spark, name, query, sql, sf_dir):
    df = query(spark, sf_dir)
    result = connect(sf_dir).execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names), name
    mine, theirs = rows_of(df.columns, df.collect()), rows_of(names, result.fetchall())
    assert len(mine) == len(theirs), (name, len(mine), len(theirs))
    differ = [(a, b) for a, b in zip(mine, theirs, strict=True) if a != b]
    assert not differ, (name, len(differ), differ[:3])
