"""Named queries over the provided tables."""

from __future__ import annotations

import importlib

MODULES = ("rule_queries", "history_queries", "log_queries", "report_queries")


def load():
    """Import all query modules; return (queries, checking statements)."""
    for module in MODULES:
        importlib.import_module(f"emberscope.catalog.{module}")
    from emberscope.catalog.registry import CHECKS, QUERIES

    return dict(QUERIES), dict(CHECKS)
