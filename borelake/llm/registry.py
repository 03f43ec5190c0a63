"""The queries and SQL of this subpackage."""

from __future__ import annotations

from importlib import import_module

MODULES = ("decontaminate", "bpe", "token_files", "simhash", "vectors", "urls", "quality", "substrings", "pages", "chat", "toxicity", "trie", "periods")


def _gathered(name: str) -> dict:
    return {k: v for m in MODULES for k, v in getattr(import_module(f"{__package__}.{m}"), name).items()}


QUERIES = _gathered("QUERIES")
SQL = _gathered("SQL")
