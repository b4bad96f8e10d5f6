"""Queries of the operators for training data, with their SQL where SQL can say it."""

from __future__ import annotations

from importlib import import_module

MODULES = ("graph_queries", "text_queries", "vector_queries", "name_queries", "leak_queries", "page_queries")


def _all(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(import_module(f"notegraph.llm.{name}"), attribute)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracles() -> dict:
    return _all("ORACLES")
