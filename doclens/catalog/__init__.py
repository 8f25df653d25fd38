"""Every query with its independent SQL twin."""

from __future__ import annotations

import importlib

from doclens.catalog.base import ORACLES, QUERIES

MODULES = [
    "sources", "profiling", "cleaning", "sampling", "text", "features", "ranking", "classification", "evaluation",
]


def load() -> tuple[dict, dict]:
    """Import all query modules and return ``(queries, oracle_sql)``."""
    for module in MODULES:
        importlib.import_module(f"doclens.catalog.{module}")
    return dict(QUERIES), dict(ORACLES)
