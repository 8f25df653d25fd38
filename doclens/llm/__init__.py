"""Operators of a training-data pipeline, each with its query. Nothing else in the library imports this."""

from __future__ import annotations

import importlib

from doclens.llm.base import ORACLES, QUERIES

MODULES = [
    "jaccard_join", "token_output", "line_dedup", "mixing", "toxicity", "warc", "sharding", "token_counts",
    "quality", "decontamination", "periodic_runs", "lexical_search", "url_filter",
]


def load() -> tuple[dict, dict]:
    """Import all operator modules and return ``(queries, oracle_sql)``."""
    for module in MODULES:
        importlib.import_module(f"doclens.llm.{module}")
    return dict(QUERIES), dict(ORACLES)
