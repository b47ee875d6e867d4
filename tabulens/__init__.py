"""Semantic-model and report analytics on Spark."""

from __future__ import annotations

import importlib

_HOMES = {"analyze": "plans.analysis", "analyze_files": "plans.analysis", "register": "plans.analysis", "write_workbook": "sources.workbook", "write_workbooks": "sources.workbook", "watch": "streaming", "sweep": "operators.graph"}


def __getattr__(name: str):
    """The functions that users start from, imported when first asked for, so that tasks import no more than they need."""
    if name not in _HOMES:
        raise AttributeError(name)
    return getattr(importlib.import_module(f".{_HOMES[name]}", __name__), name)
