"""Runnable queries over the given tables."""

from __future__ import annotations

import importlib

MODULES = ("cleaning", "packing", "evaluation", "retrieval", "operations", "streams")


def load():
    """Import all query modules once and return the registry."""
    for m in MODULES:
        importlib.import_module(f"{__name__}.{m}")
    return importlib.import_module(f"{__name__}.registry")
