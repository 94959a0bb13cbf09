"""Runs registered queries beside their SQL in DuckDB and compares the rows."""

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


def _plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(_plain(v) for v in x)
    return x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in data), key=repr)


def same(spark, query, sql, sf_dir):
    df = query(spark, sf_dir)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    con = connect(sf_dir)
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    theirs = rows(columns, result.fetchall())
    assert sorted(df.columns) == sorted(columns), (df.columns, columns)
    assert len(mine) == len(theirs), (len(mine), len(theirs))
    bad = [(a, b) for a, b in zip(mine, theirs, strict=True) if a != b]
    assert not bad, (len(bad), bad[:3])
    return len(mine)
