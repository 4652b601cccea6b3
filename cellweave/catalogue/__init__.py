"""The operators applied to the test tables: one query each, with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from importlib import import_module

MODULES = ("features", "recipes", "relational", "modelling", "learning", "records", "states")


def queries() -> dict:
    found = {}
    for m in MODULES:
        found |= import_module(f"{__name__}.{m}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found = {}
    for m in MODULES:
        found |= import_module(f"{__name__}.{m}").ORACLE_SQL
    return found
