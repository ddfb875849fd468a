"""Runnable queries, grouped by family."""

from __future__ import annotations

import importlib

FAMILIES = ("scopes", "scans", "copies", "graphs", "verdicts", "scores", "maps", "governance", "contracts")


def load():
    """Import every family and return (queries, oracle statements)."""
    from . import catalog
    for family in FAMILIES:
        importlib.import_module(f"{__name__}.{family}")
    return catalog.QUERIES, catalog.ORACLE
