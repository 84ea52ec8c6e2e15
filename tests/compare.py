"""Runs a registered query in Spark and its SQL in DuckDB and compares schema and rows."""

from __future__ import annotations

from collections import Counter
from decimal import Decimal

import duckdb

from checks.fixtures import TABLES


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    return con


def type_name(text: str) -> str:
    text = text.lower().replace(" ", "")
    return {"varchar": "string", "integer": "int", "varchar[]": "array<string>", "bigint[]": "array<bigint>"}.get(text, text)


def cell(value):
    if isinstance(value, list):
        return tuple(cell(v) for v in value)
    if isinstance(value, Decimal):
        return ("d", str(value))
    if isinstance(value, float):
        return ("f", "nan" if value != value else repr(value))
    return value


def compare(spark_frame, con, sql: str) -> str | None:
    """None if equal, else what differs."""
    names = sorted(spark_frame.columns)
    described = {r[0]: type_name(r[1]) for r in con.execute(f"describe {sql}").fetchall()}
    if sorted(described) != names:
        return f"columns {names} <> {sorted(described)}"
    types = dict(spark_frame.dtypes)
    wrong = {n: (types[n], described[n]) for n in names if types[n] != described[n]}
    if wrong:
        return f"types {wrong}"
    left = Counter(tuple(cell(r[n]) for n in names) for r in spark_frame.collect())
    cursor = con.execute(sql)
    order = [d[0] for d in cursor.description]
    at = [order.index(n) for n in names]
    right = Counter(tuple(cell(r[i]) for i in at) for r in cursor.fetchall())
    if left != right:
        return (f"rows {sum(left.values())} <> {sum(right.values())}; "
                f"spark only {list((left - right).items())[:3]}; sql only {list((right - left).items())[:3]}; columns {names}")
    return None
