"""Compare registered queries with their SQL run by DuckDB."""

from __future__ import annotations

import math
import pathlib

import duckdb

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    con = duckdb.connect()
    for name in NAMES:
        if pathlib.Path(f"{folder}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else repr(value)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return str(value)


def rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in records)


TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "float": "FLOAT"}


def difference(spark, folder: str, build, sql: str):
    """None when both give the same columns, types and rows, else what differs."""
    df = build(spark, folder)
    result = connect(folder).execute(sql)
    names = [d[0] for d in result.description]
    theirs_types = {d[0]: str(d[1]) for d in result.description}
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    for field in df.schema:
        want = TYPES.get(field.dataType.simpleString())
        if want != theirs_types[field.name]:
            return f"type of {field.name}: {field.dataType.simpleString()} against {theirs_types[field.name]}"
    ours = rows(df.columns, [tuple(r) for r in df.collect()])
    theirs = rows(names, result.fetchall())
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    for a, b in zip(ours, theirs):
        if a != b:
            wrong = sum(x != y for x, y in zip(ours, theirs))
            cell = next((i, x[:300], y[:300]) for i, (x, y) in enumerate(zip(a, b)) if x != y)
            return f"{wrong} of {len(ours)} rows differ, first {a[0]} / {b[0]} at column {sorted(names)[cell[0]]}: {cell[1]!r} against {cell[2]!r}"
    return None
