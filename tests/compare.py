"""Runs a registered query and its SQL on the same tables."""

import glob
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def norm(v):
    if isinstance(v, float):
        return 0.0 if v == 0 else v
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


def rows_of(spark, sf, con, query, sql):
    cur = con.execute(sql)
    names = sorted(c[0] for c in cur.description)
    order = [[c[0] for c in cur.description].index(n) for n in names]
    want = sorted((tuple(norm(r[i]) for i in order) for r in cur.fetchall()), key=repr)
    df = query(spark, sf)
    assert sorted(df.columns) == names, (sorted(df.columns), names)
    got = sorted((tuple(map(norm, r)) for r in df.select(*[f"`{n}`" for n in names]).collect()), key=repr)
    return names, got, want
