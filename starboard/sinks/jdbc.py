"""Relational tables over JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame

from starboard.sources.jdbc import jdbc_options

CONNECTIONS = 16


def write_options(
    url: str, table: str, properties: dict[str, str] | None = None, connections: int = CONNECTIONS
) -> dict[str, str]:
    """``truncate`` keeps a refilled table's own columns and indexes."""
    options = jdbc_options(url, table, properties)
    options.pop("fetchsize")
    return {"batchsize": "10000", "numPartitions": str(connections), "truncate": "true", **options}


def write_jdbc(
    df: DataFrame,
    url: str,
    table: str,
    properties: dict[str, str] | None = None,
    mode: str = "append",
    connections: int = CONNECTIONS,
) -> None:
    """Append to, or with mode "overwrite" refill, a table. Errors are raised.

    ``connections`` tasks write; the shuffle before them leaves the work up to there parallel.
    Each task commits its own rows: after a lost executor a repeated task can append a second
    time, so a table that must hold each row once should be refilled or have a unique key.
    """
    options = write_options(url, table, properties, connections)
    df.repartition(connections).write.format("jdbc").options(**options).mode(mode).save()
