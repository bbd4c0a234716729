"""Results of a query and of its SQL as multisets of rows."""

import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events docs postings arrivals kbs checklist documents mix_targets given_names embeddings".split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def differences(df, con, sql):
    got = df.toArrow()
    names = sorted(got.column_names)
    ours = Counter(tuple(plain(r[c]) for c in names) for r in got.to_pylist())
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    if sorted(columns) != names:
        return [columns, names]
    theirs = Counter(tuple(plain(r[columns.index(c)]) for c in names) for r in found.fetchall())
    return [*((ours - theirs) + (theirs - ours)).items()][:5]
