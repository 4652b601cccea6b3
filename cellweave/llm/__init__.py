"""Operators for preparing training text, each with a thin query over the test tables.

``queries()`` and ``oracle_sql()`` gather what the modules register.
"""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "secret_scan",
    "chat_format",
    "toxicity",
    "fingerprint",
    "token_count",
    "topk_search",
    "packing",
    "suffix_dedup",
    "minhash_dedup",
    "bpe_codec",
    "token_alignment",
    "repetition",
    "fim",
)


def queries() -> dict:
    """Name -> function of (spark, sf_dir), of every operator."""
    found = {}
    for name in MODULES:
        found |= import_module(f"{__name__}.{name}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    """Name -> DuckDB SQL, where SQL can express the query."""
    found = {}
    for name in MODULES:
        found |= getattr(import_module(f"{__name__}.{name}"), "ORACLE_SQL", {})
    return found
