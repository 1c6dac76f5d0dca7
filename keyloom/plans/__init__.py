"""Registered queries: what the driver runs, with the SQL of each."""

from __future__ import annotations

import importlib
import pkgutil


def load() -> None:
    """Import every module of queries, which registers them."""
    for m in pkgutil.iter_modules(__path__):
        if m.name.endswith("_queries"):
            importlib.import_module(f"{__name__}.{m.name}")
