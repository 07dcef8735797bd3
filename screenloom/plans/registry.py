"""Where queries are registered with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from screenloom.plans.sql import sql

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, select: str | None = None) -> Callable:
    """Registers a query, and its SQL where there is one."""

    def take(f: Callable) -> Callable:
        QUERIES[name] = f
        if select:
            ORACLE[name] = sql(select)
        return f

    return take
