"""Rows of a query against rows of its SQL."""

import math
import os
from collections import Counter
from decimal import Decimal

import duckdb


def connection(data):
    con = duckdb.connect()
    for f in os.listdir(data):
        p = os.path.join(data, f)
        con.execute(f"create view {f.split('.')[0]} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def plain(v):
    if isinstance(v, (float, Decimal)):
        return None if math.isnan(v) else round(float(v), 5)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def same(df, con, sql):
    columns = sorted(df.columns)
    mine = Counter(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    theirs = Counter(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in cur.fetchall())
    assert mine == theirs, (list((mine - theirs))[:3], list((theirs - mine))[:3])
