"""All queries of the library by name, and the SQL that must agree with them."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers ``fn(spark, sf_dir)`` under its name, with its SQL where there is one."""

    def add(fn):
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return add
