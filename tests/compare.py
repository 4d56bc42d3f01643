"""Compare a registered query with its oracle in DuckDB."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter

import duckdb

from barrio.fixtures import BASE_TABLES

FAMILY = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
    "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz", "FLOAT": "float",
}


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in BASE_TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return value + 0.0
    if isinstance(value, datetime.datetime):
        return value.isoformat(sep=" ")
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def differences(df, con, sql: str) -> list[str]:
    """Human-readable differences; empty when equal."""
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    kinds = {r[0]: r[1] for r in con.execute(f"describe {sql}").fetchall()}
    want_rows = con.execute(sql).fetchall()
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} vs {sorted(names)}"]
    out = []
    for name, kind in df.dtypes:
        if FAMILY.get(kinds[name]) != kind:
            out.append(f"type of {name}: {kind} vs {kinds[name]}")
    order = sorted(names)
    got = Counter(tuple(plain(r[c]) for c in order) for r in df.collect())
    pos = [names.index(c) for c in order]
    want = Counter(tuple(plain(r[i]) for i in pos) for r in want_rows)
    if got != want:
        out.append(f"rows {sum(got.values())} vs {sum(want.values())}")
        for label, diff in (("only spark", got - want), ("only sql", want - got)):
            for row, n in list(sorted(diff.items(), key=repr))[:4]:
                out.append(f"{label} x{n}: {dict(zip(order, row))}")
    if not want_rows:
        out.append("note: no rows")
    return out
