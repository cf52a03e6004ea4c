"""Holds a query's rows against its SQL in DuckDB."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if x is None or x != x:
        return None
    if isinstance(x, float):
        return float(f"{x:.9g}") if math.isfinite(x) else x
    return str(x) if not isinstance(x, (bool, int, str)) else x


def rows(cols, found):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


def compare(spark, fn, sql: str, sf_dir: str) -> int:
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = rows(cols, cur.fetchall())
    df = fn(spark, sf_dir)
    assert sorted(df.columns) == sorted(cols)
    got = rows(df.columns, df.collect())
    assert len(got) == len(want)
    assert got == want
    return len(got)
