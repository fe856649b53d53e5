"""Where queries register themselves with their SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *ctes: str) -> Callable[[Callable], Callable]:
    """Registers a query under its function's name; sql may build on common table expressions."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = (f"WITH {', '.join(ctes)} " if ctes else "") + sql
        return f

    return add
