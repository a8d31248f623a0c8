"""Registry of the training-data queries: name -> (query, SQL or None)."""

from __future__ import annotations

REGISTRY: dict = {}


def register(name: str, sql: str | None = None):
    """Decorator: file a query under ``name`` with its equivalent SQL."""

    def add(f):
        REGISTRY[name] = (f, sql)
        return f

    return add
