"""Compare registered queries with their DuckDB SQL."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for name in TABLES:
        path = Path(folder) / f"{name}.parquet"
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(_plain(r[i]) for i in order) for r in rows), key=lambda t: tuple(map(repr, t))
    )


def compare(df, con, sql) -> str | None:
    """None when equal, else what differs."""
    expected = con.sql(sql)
    want_columns = list(expected.columns)
    if sorted(df.columns) != sorted(want_columns):
        return f"columns {sorted(df.columns)} != {sorted(want_columns)}"
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    want = rows_of(want_columns, expected.fetchall())
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} rows differ, first {sorted(df.columns)}: {bad[0][0]} != {bad[0][1]}"
    kinds = dict(zip(want_columns, (str(t) for t in expected.types)))
    loose = {
        "string": "VARCHAR", "bigint": "BIGINT", "double": "DOUBLE", "int": "INTEGER", "boolean": "BOOLEAN",
    }
    for name, kind in df.dtypes:
        if kind in loose and loose[kind] != kinds[name]:
            return f"type of {name}: {kind} != {kinds[name]}"
    return None
