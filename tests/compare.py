"""Rows of a Spark query against rows of SQL on the same tables."""

import glob
import math
import os

import duckdb


def duck(sf_dir: str):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(p).removesuffix(".parquet")
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{p}')")
    return c


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if hasattr(x, "tolist"):
        return plain(x.tolist())
    if isinstance(x, list | tuple):
        return tuple(map(plain, x))
    return x


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


def same(df, sql: str, sf_dir: str) -> None:
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    found = duck(sf_dir).execute(sql)
    want = rows([d[0] for d in found.description], found.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
