"""Rows of a Spark query against those of its SQL in DuckDB."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v) if type(v).__name__ == "Decimal" else v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, f, sql, sf_dir):
    df = f(spark, sf_dir)
    got = rows(df.columns, df.collect())
    cur = connect(sf_dir).execute(sql)
    want = rows([d[0] for d in cur.description], cur.fetchall())
    assert got[0] == want[0]
    if got[1] != want[1]:
        bad = [(g, w) for g, w in zip(got[1], want[1], strict=False) if g != w][:3]
        raise AssertionError(f"{len(got[1])} rows against {len(want[1])}: {bad}")
    return len(got[1])
