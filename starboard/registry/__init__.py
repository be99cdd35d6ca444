"""Every operator as a named query over the given tables, with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starboard.registry.oracle import with_tables

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Run
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    """Register a query; its SQL may read the tables defined in ``registry.oracle``."""

    def register(run: Run) -> Run:
        if name in ENTRIES:
            raise ValueError(f"{name} is registered twice")
        ENTRIES[name] = Entry(run, with_tables(sql) if sql else None)
        return run

    return register


def r6(column: str) -> Column:
    """Six decimals: sums of doubles may differ beyond them with the order of adding."""
    return F.round(column, 6).alias(column)


def load_all() -> dict[str, Entry]:
    from starboard.registry import (  # noqa: F401
        aggregates,
        cleaning,
        columns,
        joins,
        plans,
        ranking,
        recommend,
        scans,
        serving,
        sinks,
    )

    return ENTRIES
