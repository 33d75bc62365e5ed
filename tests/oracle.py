"""Compare a registered query with its SQL on the same Parquet tables."""

from __future__ import annotations

import datetime as dt
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Spark type -> DuckDB type of a matching column.
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP",
}


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{folder}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _key(value):
    if value is None:
        return (0, "")
    if isinstance(value, float):
        return (1, repr(value))
    if isinstance(value, dt.datetime):
        return (1, value.isoformat())
    return (1, str(value))


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(_key(r[i]) for i in order) for r in rows])


def difference(df, sql: str, con) -> str:
    """Empty when equal, else the first thing that differs."""
    got = rows_of(df.columns, df.collect())
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    want_types = dict(zip(names, (str(d[1]) for d in rel.description)))
    want = rows_of(names, rel.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    for name, kind in df.dtypes:
        if TYPES.get(kind) != want_types[name]:
            return f"type of {name}: {kind} / {want_types[name]}"
    if len(got) != len(want):
        return f"rows {len(got)} / {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            return f"row\n  {str(a)[:600]}\n  {str(b)[:600]}"
    return ""
