"""Compares a query with its oracle on the same Parquet files."""

import math
from pathlib import Path

import duckdb


def _value(x):
    if isinstance(x, bool):
        return x
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if isinstance(x, (list, tuple)):
        return tuple(map(_value, x))
    return x


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_value(r[i]) for i in order) for r in found), key=repr)


def connection(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def same(df, con, sql):
    got = con.execute(sql)
    columns = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.collect(), df.columns) == rows(got.fetchall(), columns)
