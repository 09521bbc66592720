"""Runs queries and their SQL side by side on one folder of tables."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v + 0.0)
    return v if v is None or isinstance(v, (bool, int)) else str(v)


def rows_of(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


def differences(spark, con, sf_dir, query, sql):
    """Empty if equal: names, number of rows and values."""
    df = query(spark, sf_dir)
    rel = con.sql(sql)
    names = list(rel.columns)
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    a, b = rows_of(df.collect(), df.columns), rows_of(rel.fetchall(), names)
    if len(a) != len(b):
        return f"rows {len(a)} and {len(b)}"
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{len(bad)} of {len(a)} rows differ: {bad[0]}" if bad else ""
