"""Runs queries beside their SQL counterparts and compares the rows, whatever their order."""

from __future__ import annotations

import math
from pathlib import Path


def plain(v):
    """A value in a form that both engines share."""
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool) or isinstance(v, str):
        return v
    if hasattr(v, "isoformat"):
        return str(v)
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((str(k), plain(x)) for k, x in v.items()))
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return int(v)


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)


def rows_of_sql(sql: str, folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET threads = 4")
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in got.fetchall()), key=repr)
