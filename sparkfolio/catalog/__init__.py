"""Queries over the given tables, one per operator, with SQL twins."""

from __future__ import annotations

import importlib
import pkgutil


def load():
    """Import every ``q_*`` module once and return (queries, oracles)."""
    from sparkfolio.catalog import registry

    for m in pkgutil.iter_modules(__path__):
        if m.name.startswith("q_"):
            importlib.import_module(f"{__name__}.{m.name}")
    return registry.QUERIES, registry.ORACLES
