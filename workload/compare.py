"""Compare a query with its SQL twin: column names, types, row count and values."""

from __future__ import annotations

import datetime as dt
import math

import duckdb
from pyspark.sql import SparkSession

from workload.oracle import ORACLE
from workload.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
# Types that count as the same on both sides.
KINDS = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "DATE": "date", "TIMESTAMP": "timestamp_ntz", "BOOLEAN": "boolean",
}


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def _key(row):
    return tuple((v is None, "" if v is None else repr(v)) for v in row)


def _value(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    return dt.datetime(v.year, v.month, v.day) if isinstance(v, dt.date) and not isinstance(v, dt.datetime) else v


def differences(spark: SparkSession, con, sf: str, name: str) -> list[str]:
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    ours = sorted((tuple(_value(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=_key)
    described = con.execute("DESCRIBE " + ORACLE[name]).fetchall()
    kinds = {r[0]: r[1] for r in described}
    out = []
    if cols != sorted(kinds):
        return [f"columns {cols} against {sorted(kinds)}"]
    for c, t in df.dtypes:
        if KINDS.get(kinds[c], kinds[c]) != t:
            out.append(f"type of {c}: {t} against {kinds[c]}")
    listed = ", ".join(f'"{c}"' for c in cols)
    theirs = con.execute(f"SELECT {listed} FROM ({ORACLE[name]})").fetchall()
    theirs = sorted((tuple(_value(v) for v in r) for r in theirs), key=_key)
    if len(ours) != len(theirs):
        out.append(f"rows {len(ours)} against {len(theirs)}")
    bad = [(a, b) for a, b in zip(ours, theirs) if _key(a) != _key(b)]
    if bad:
        out.append(f"{len(bad)} rows differ, first {bad[0]}")
    return out
