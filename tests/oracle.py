"""Comparison of a query's rows with DuckDB's rows of its SQL."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float) or hasattr(v, "as_tuple"):
        return "number", float(f"{float(v):.9g}") if v == v else None
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def compared(df, con, sql: str):
    """(rows of df, rows of the SQL), sorted, columns in df's order."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns), (names, df.columns)
    order = [names.index(c) for c in df.columns]
    own = sorted((tuple(map(plain, r)) for r in df.collect()), key=repr)
    other = sorted((tuple(plain(r[i]) for i in order) for r in result.fetchall()), key=repr)
    return own, other
