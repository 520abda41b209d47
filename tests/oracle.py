"""Compares a query with its SQL twin as the driver does: rows, columns, values."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        if os.path.exists(path := f"{sf_dir}/{name}.parquet"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*' * os.path.isdir(path)}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value + 0.0, 6) + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(plain, value)) + "]"
    return str(value)


def differences(spark, query, sql, sf_dir):
    """Empty if both give the same columns and rows, else what differs."""
    got = query(spark, sf_dir)
    result = connect(sf_dir).execute(sql)
    names = [x[0] for x in result.description]
    if sorted(names) != sorted(got.columns):
        return f"columns {sorted(got.columns)} and {sorted(names)}"
    order = sorted(names)
    theirs = sorted(tuple(plain(row[names.index(c)]) for c in order) for row in result.fetchall())
    ours = sorted(tuple(plain(row[c]) for c in order) for row in got.collect())
    if ours == theirs:
        return "" if ours else "no rows"
    if len(ours) != len(theirs):
        return f"{len(ours)} and {len(theirs)} rows"
    return next(f"{a} and {b}" for a, b in zip(ours, theirs) if a != b)
