"""How a query and its SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function of (spark, sf_dir), and DuckDB SQL for the same rows where it can express them."""

    def put(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


def r6(c: str | Column, name: str | None = None) -> Column:
    """Rounded to six places, as engines sum in different orders."""
    col = F.col(c) if isinstance(c, str) else c
    return (F.round(col, 6) + 0.0).alias(name or c)  # + 0.0 makes -0.0 a 0.0
