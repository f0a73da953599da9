"""All registered queries."""

from __future__ import annotations

from weekcast.catalog.registry import REGISTRY


def load() -> dict:
    """Import every query module and return the registry."""
    import importlib

    for name in ("prepare", "features", "reports", "modelling"):
        importlib.import_module(f"weekcast.catalog.{name}")
    return REGISTRY
