"""Run a query and its SQL side by side."""

import datetime
import decimal
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(v):
    if isinstance(v, dict) or hasattr(v, "asDict"):
        return str([plain(x) for x in (v.asDict() if hasattr(v, "asDict") else v).values()])
    if isinstance(v, list | tuple):
        return str([plain(x) for x in v])
    if v is None or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, float | decimal.Decimal) and not isinstance(v, bool):
        return f"{float(v) + 0.0:.9g}"
    if isinstance(v, int) and not isinstance(v, bool) and abs(v) < 1 << 53:
        return str(v)
    if isinstance(v, datetime.date):
        return v.isoformat()
    return str(v)


def rows(names: list[str], values: list) -> list[tuple]:
    """Rows with columns by name, in a fixed order; whole floats equal integers."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(int(v) if isinstance(v, float) and v.is_integer() and abs(v) < 1 << 53 else v) for v in (r[i] for i in order)) for r in values)
