"""Relational tables over JDBC.

A plain read is one connection and one task. For a large table name a numeric column and its
range: Spark then reads the slices in parallel (rows outside the range fall into the first
and last slice, so none is lost).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Slices:
    column: str
    lower: int
    upper: int
    count: int

    def options(self) -> dict[str, str]:
        return {
            "partitionColumn": self.column,
            "lowerBound": str(self.lower),
            "upperBound": str(self.upper),
            "numPartitions": str(self.count),
        }


def jdbc_options(
    url: str, table: str, properties: dict[str, str] | None = None, slices: Slices | None = None
) -> dict[str, str]:
    options = {"url": url, "dbtable": table, "fetchsize": "10000"}
    options.update(properties or {})
    if slices:
        options.update(slices.options())
    return options


def subquery(sql: str, alias: str = "q") -> str:
    """A query in the place of a table name."""
    return f"({sql}) {alias}"


def read_jdbc_table(
    spark: SparkSession,
    url: str,
    table: str,
    properties: dict[str, str] | None = None,
    slices: Slices | None = None,
    drop: tuple[str, ...] = (),
) -> DataFrame:
    """A table, without the columns (such as arrays) its driver cannot return."""
    return spark.read.format("jdbc").options(**jdbc_options(url, table, properties, slices)).load().drop(*drop)


def read_jdbc_query(
    spark: SparkSession,
    url: str,
    sql: str,
    properties: dict[str, str] | None = None,
    slices: Slices | None = None,
) -> DataFrame:
    return read_jdbc_table(spark, url, subquery(sql), properties, slices)
