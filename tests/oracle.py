"""Compare a query with its SQL on the same tables, as multisets of rows."""

import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{folder}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    return con


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    return v


def same(df, con, sql):
    cols = sorted(df.columns)
    mine = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    theirs = Counter(tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert mine == theirs, (list((mine - theirs).items())[:3], list((theirs - mine).items())[:3])
