"""Runs a query in Spark and its SQL in DuckDB and compares the rows."""

import math
from pathlib import Path

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p if p.is_file() else f'{p}/*.parquet'}')")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def plain(x):
        if isinstance(x, float):
            return None if math.isnan(x) else round(x, 6) + 0.0
        return x

    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, con, sf_dir, query, sql):
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    out = con.execute(sql)
    want = rows([c[0] for c in out.description], out.fetchall())
    assert sorted(df.columns) == sorted(c[0] for c in out.description)
    assert len(got) == len(want), (len(got), len(want))
    for g, w in zip(got, want):
        for x, y in zip(g, w):
            same = x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-6))
            assert same, (g, w)
