"""Registered queries: each pairs a Spark build on the test tables with an independent SQL text."""

from __future__ import annotations

from importlib import import_module

from matchform.catalog.registry import ORACLES, QUERIES

MODULES = (
    "scalar_queries",
    "history_queries",
    "join_queries",
    "aggregate_queries",
    "scoring_queries",
    "fold_queries",
    "page_queries",
    "model_queries",
)


def load():
    """Import every query module and return the registered queries and SQL texts."""
    for name in MODULES:
        import_module(f"matchform.catalog.{name}")
    return QUERIES, ORACLES
