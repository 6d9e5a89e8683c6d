"""Registered queries over the test tables, and the SQL that checks them."""

from __future__ import annotations

from importlib import import_module

MODULES = ("matches", "features", "scoring", "forecasters", "imbalance", "corpus", "panel", "graph")


def _collect(attribute: str) -> dict:
    found: dict = {}
    for name in MODULES:
        for key, value in getattr(import_module(f"{__name__}.{name}"), attribute).items():
            if key in found:
                raise KeyError(f"registered twice: {key}")
            found[key] = value
    return found


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict:
    return _collect("ORACLE")
