"""Run a query on Spark and its SQL on DuckDB and compare values."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def duck(folder: str):
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[:-8]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    if hasattr(value, "item"):
        return _plain(value.item())
    if hasattr(value, "isoformat"):
        return value.isoformat()[:10]
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in data]
    return sorted(columns), sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(df, sql: str, folder: str, examples: int = 3) -> list[str]:
    """Differences as text; empty when the two results are equal."""
    names, mine = rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck(folder).execute(sql)
    theirs_names, theirs = rows([d[0] for d in cursor.description], cursor.fetchall())
    if names != theirs_names:
        return [f"columns {names} != {theirs_names}"]
    if len(mine) != len(theirs):
        return [f"{len(mine)} rows != {len(theirs)} rows"]
    wrong = [(a, b) for a, b in zip(mine, theirs) if a != b]
    out = []
    for a, b in wrong[:examples]:
        out.append(str({n: (x, y) for n, x, y in zip(names, a, b) if x != y}))
    return [f"{len(wrong)} of {len(mine)} rows differ"] + out if wrong else []
