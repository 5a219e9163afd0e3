"""Runs a registered query on Spark and its oracle on DuckDB and compares rows and types."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import math
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def _norm(v):
    if v is None:
        return "~null"
    if isinstance(v, bool):
        return f"b{int(v)}"
    if isinstance(v, decimal.Decimal):
        return f"D{v}"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"f{round(v, 9) + 0.0!r}"
    if isinstance(v, int):
        return f"i{v}"
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return str(v)


KIND = {"bigint": "int", "int": "int", "smallint": "int", "tinyint": "int", "double": "float", "float": "float", "string": "str",
        "boolean": "bool", "timestamp_ntz": "ts", "timestamp": "ts", "date": "date",
        "BIGINT": "int", "INTEGER": "int", "SMALLINT": "int", "TINYINT": "int", "DOUBLE": "float", "FLOAT": "float",
        "VARCHAR": "str", "BOOLEAN": "bool", "TIMESTAMP": "ts", "TIMESTAMP WITH TIME ZONE": "ts", "DATE": "date"}


def compare(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    rel = con.sql(sql)
    cols, dcols = sorted(df.columns), sorted(rel.columns)
    if cols != dcols:
        return f"columns: spark {cols} duck {dcols}"
    st = {f.name: KIND.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    dtp = {n: KIND.get(str(ty), str(ty)) for n, ty in zip(rel.columns, rel.types)}
    bad = {n: (st[n], dtp[n]) for n in cols if st[n] != dtp[n] and '"NULL"' not in dtp[n]}
    if bad:
        return f"types: {bad}"
    a = sorted(tuple(_norm(r[x]) for x in cols) for r in df.collect())
    ix = [rel.columns.index(x) for x in cols]
    b = sorted(tuple(_norm(r[i]) for i in ix) for r in rel.fetchall())
    if a != b:
        sa, sb = set(a), set(b)
        return f"rows: spark {len(a)} duck {len(b)}; only spark {list(sa - sb)[:2]}; only duck {list(sb - sa)[:2]} cols {cols}"
    return None if a else "empty"
