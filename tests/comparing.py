"""Rows of a Spark query against those of its SQL in DuckDB."""

import glob
import os

import duckdb


def duck(sf_dir: str):
    c = duckdb.connect()
    for p in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return c


def plain(v):
    if v is None or isinstance(v, str | bool):
        return v
    try:
        f = float(v)
    except (TypeError, ValueError):
        return str(v)
    return None if f != f else round(f, 6) + 0.0


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


def same(df, c, sql: str) -> None:
    cursor = c.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    mine, theirs = rows(df.columns, df.collect()), rows(names, cursor.fetchall())
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-4 * max(1, abs(y)), (a, b)
