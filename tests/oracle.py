"""Compares a DataFrame with SQL on the same tables."""

import math
import os

import duckdb

SMALL = "/root/testdata/sf0.001"

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def connect(folder):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(x):
    if isinstance(x, (list, tuple)):
        return [plain(y) for y in x]
    if isinstance(x, bool) or x is None or isinstance(x, (int, str)):
        return str(x)
    try:
        return "nan" if math.isnan(x) else repr(round(float(x), 9) + 0.0)
    except TypeError:
        return str(x)


def same(df, con, sql):
    columns = sorted(df.columns)
    ours = sorted([plain(r[c]) for c in columns] for r in df.collect())
    relation = con.sql(sql)
    assert sorted(relation.columns) == columns
    at = [relation.columns.index(c) for c in columns]
    theirs = sorted([plain(r[i]) for i in at] for r in relation.fetchall())
    assert len(ours) == len(theirs)
    assert [x for x in zip(ours, theirs, strict=True) if x[0] != x[1]][:3] == []
