"""Registration of queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from .views import SQL

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None, base: bool = True):
    """Register ``f(spark, sf_dir)``; ``sql`` continues the WITH clause of the shared views unless ``base`` is false."""

    def wrap(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = SQL + sql if base else sql
        return f

    return wrap
