"""Registered queries: each entry runs one operator over whole driver tables.

A module contributes ``QUERIES`` (name -> callable(spark, folder) -> DataFrame)
and ``SQL`` (name -> the same result as DuckDB SQL, where SQL can say it).
"""

from __future__ import annotations

from importlib import import_module

MODULES = ("kpi", "profile", "scans", "workspace", "catalog", "series", "similar", "models", "sources")


def load() -> tuple[dict, dict]:
    queries, sql = {}, {}
    for name in MODULES:
        module = import_module(f"{__name__}.{name}")
        queries.update(module.QUERIES)
        sql.update(module.SQL)
    return queries, sql
