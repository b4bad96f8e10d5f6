"""All queries of the core, by name."""

from __future__ import annotations

from importlib import import_module

MODULES = ("references", "graph", "text", "search", "pages", "review", "read")


def _all(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(import_module(f"notegraph.plans.{name}"), attribute)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracles() -> dict:
    return _all("ORACLES")
