"""Runs a registered query and its checking SQL and compares the rows."""

from __future__ import annotations

import datetime
import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v + 0.0:.12g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def _sorted(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(plain, key=repr), [names[i] for i in order]


def differences(df, con, sql: str) -> tuple[int, list[str]]:
    """Row count and what differs (names, types, rows), nothing when equal."""
    got, names = _sorted([tuple(r) for r in df.collect()], df.columns)
    cur = con.execute(sql)
    want, wanted = _sorted(cur.fetchall(), [c[0] for c in cur.description])
    types = {n: t for n, t in df.dtypes}
    con_types = {c[0]: str(c[1]) for c in cur.description}
    out = []
    if names != wanted:
        return len(got), [f"columns {names} <> {wanted}"]
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN", "string": "VARCHAR"}
    sql_types = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    for n in names:
        if kinds.get(types[n]) != sql_types[n]:
            out.append(f"type of {n}: {types[n]} <> {sql_types[n]}")
    if got != want:
        miss, more = [r for r in want if r not in set(got)][:3], [r for r in got if r not in set(want)][:3]
        out.append(f"{len(got)} <> {len(want)} rows; missing {miss}; extra {more}")
    return len(got), out
