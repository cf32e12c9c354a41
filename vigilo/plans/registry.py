"""Registry of named queries: each entry is a Spark builder
``(spark, sf_dir) -> DataFrame`` plus, where the operator is expressible in
SQL, the DuckDB oracle text over the same parquet views."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from ..sources.adapters import EVENTS_CTE, LINEITEM_CTE


@dataclass
class Entry:
    name: str
    build: Callable
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(name, fn, sql)
        return fn
    return deco


def ev_sql(body: str, *ctes: str) -> str:
    """Oracle text over the ``txn_events`` view (plus extra CTEs)."""
    return "WITH " + ",\n".join([EVENTS_CTE, *ctes]) + "\n" + body


def li_sql(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([LINEITEM_CTE, *ctes]) + "\n" + body


def both_sql(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([EVENTS_CTE, LINEITEM_CTE, *ctes]) + "\n" + body
