"""Where queries are registered together with their SQL."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None, views: tuple[str, ...] = ()):
    """Registers a query under its function's name."""

    def add(f):
        from .views import oracle

        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = oracle(sql, *views)
        return f

    return add
