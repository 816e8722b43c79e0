"""Compare a Spark result with a DuckDB result: names, types, rows, values."""

from __future__ import annotations

import datetime as dt
import math
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
_TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "DATE": "date", "BOOLEAN": "boolean"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return (0, "")
    if isinstance(v, bool):
        return (1, v)
    if isinstance(v, (int, float, Decimal)):
        return (2, float(v))
    if isinstance(v, (dt.date, dt.datetime)):
        return (3, str(v))
    return (4, str(v))


def differences(df, con, sql: str) -> list[str]:
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    types = [str(c[1]) for c in rel.description]
    out = []
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} vs {sorted(names)}"]
    spark_types = dict(df.dtypes)
    for n, t in zip(names, types):
        if _TYPES.get(t, t) != spark_types[n]:
            out.append(f"type of {n}: {spark_types[n]} vs {t}")
    order = sorted(names)
    theirs = sorted(tuple(_cell(row[names.index(c)]) for c in order) for row in rel.fetchall())
    pdf = df.select(*order).collect()
    ours = sorted(tuple(_cell(v) for v in row) for row in pdf)
    if len(ours) != len(theirs):
        out.append(f"rows {len(ours)} vs {len(theirs)}")
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if bad:
        out.append(f"{len(bad)} rows differ, first {order}: {bad[0]}")
    return out
