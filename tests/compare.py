"""Compare a Spark result with the rows DuckDB returns for the oracle SQL."""

from __future__ import annotations

import math
from collections import Counter
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        path = Path(sf_dir) / f"{table}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, Decimal):
        return int(value) if value == int(value) else float(value)
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    return value


def _bag(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def differences(df, con, sql: str) -> list[str]:
    """Human-readable differences; empty when columns, row counts and values agree."""
    cursor = con.execute(sql)
    wanted_columns = [d[0] for d in cursor.description]
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    wanted = _bag(wanted_columns, cursor.fetchall())
    if sorted(df.columns) != sorted(wanted_columns):
        return [f"columns {sorted(df.columns)} != {sorted(wanted_columns)}"]
    pairs = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}
    problems = [
        f"type of {name}: {kind} != {kinds[name]}"
        for name, kind in df.dtypes
        if kind in pairs and kinds[name] not in (pairs[kind], "STRING", "NUMBER", "bool")
        and kinds[name] != pairs[kind]
    ]
    got = _bag(df.columns, [tuple(r) for r in df.collect()])
    if sum(got.values()) != sum(wanted.values()):
        problems.append(f"rows {sum(got.values())} != {sum(wanted.values())}")
    for label, bag in (("only in Spark", got - wanted), ("only in SQL", wanted - got)):
        for row in list(bag)[:3]:
            problems.append(f"{label}: {row}")
    return problems
