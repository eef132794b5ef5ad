"""Comparing a query with its SQL: the same rows, columns by name, floats to nine digits."""

import math
import os

import duckdb


def connection(sf: str):
    con = duckdb.connect()
    for f in sorted(os.listdir(sf)):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    if isinstance(x, (bytes, bytearray)):
        return bytes(x)
    return x


def ordered(columns, rows):
    at = [i for i, _ in sorted(enumerate(columns), key=lambda c: c[1])]
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


def same(df, sql: str, con) -> int:
    """Assert that df gives the rows of the SQL; how many there are."""
    cursor = con.execute(sql)
    want_columns = [c[0] for c in cursor.description]
    want = ordered(want_columns, cursor.fetchall())
    got = ordered(df.columns, [tuple(r) for r in df.collect()])
    assert sorted(df.columns) == sorted(want_columns)
    assert len(got) == len(want), (len(got), len(want))
    for a, b in zip(got, want, strict=True):
        if a != b:
            close = all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-6 * max(1, abs(x))) for x, y in zip(a, b, strict=True))
            assert close, (a, b)
    return len(got)
