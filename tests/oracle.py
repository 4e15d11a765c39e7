"""Compare registered queries with their SQL in DuckDB."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import os

import duckdb


def connect(path: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in glob.glob(f"{path}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def norm(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return int(v) if v == int(v) and abs(v) < 2**53 else round(v, 9) + 0.0
    if isinstance(v, (dt.datetime, dt.date)):
        return str(v)
    return v


def key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def compare(cols_a, rows_a, cols_b, rows_b) -> str | None:
    """None when equal, else a short description of the difference."""
    if sorted(cols_a) != sorted(cols_b):
        return f"columns differ: only spark {sorted(set(cols_a) - set(cols_b))}, only sql {sorted(set(cols_b) - set(cols_a))}"
    ia, ib = [cols_a.index(c) for c in sorted(cols_a)], [cols_b.index(c) for c in sorted(cols_a)]
    a = sorted((tuple(norm(r[i]) for i in ia) for r in rows_a), key=key)
    b = sorted((tuple(norm(r[i]) for i in ib) for r in rows_b), key=key)
    if len(a) != len(b):
        extra = [x for x in a if x not in set(b)][:2], [x for x in b if x not in set(a)][:2]
        return f"rows {len(a)} vs {len(b)}; cols {sorted(cols_a)}; e.g. {extra}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if not bad:
        return None
    names = sorted(cols_a)
    diff = {names[i]: (x, y) for i, (x, y) in enumerate(zip(*bad[0])) if x != y}
    return f"{len(bad)} of {len(a)} rows differ; cols {names}; first {bad[0][0]}; differing {diff}"
