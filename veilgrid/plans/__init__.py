"""Registered queries, grouped by the kind of operator they exercise."""

from __future__ import annotations

import importlib

MODULES = ["sources", "predicates", "text", "geometry", "spatial", "lookups", "aggregates", "ordered", "resampling", "models", "saturated"]


def load():
    """Import every group once and return the registry."""
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return importlib.import_module(f"{__name__}.registry")
