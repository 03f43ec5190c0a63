"""All queries over the log tables, and their SQL."""

from __future__ import annotations

from importlib import import_module

from borelake.shared import run

MODULES = ("series", "labels", "convention", "review", "reports")


def _gathered(name: str) -> dict:
    return {k: v for m in MODULES for k, v in getattr(import_module(f"{__package__}.{m}"), name).items()}


QUERIES = {name: run(query) for name, query in _gathered("QUERIES").items()}
SQL = _gathered("SQL")
