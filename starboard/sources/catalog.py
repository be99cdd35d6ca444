"""Catalogue tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starboard.schemas import CSV_READ


def valid_table(spark: SparkSession, name: str, columns: list[str]) -> DataFrame:
    return spark.table(name).where(F.col("is_valid")).select(*columns)


def databases(spark: SparkSession) -> list[str]:
    return [d.name for d in spark.catalog.listDatabases()]


def tables(spark: SparkSession, database: str) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables(database) if not t.isTemporary)


def use_database(spark: SparkSession, database: str) -> None:
    spark.catalog.setCurrentDatabase(database)


def verify_catalog(spark: SparkSession, database: str, expected: list[str]) -> DataFrame:
    """(check, table_name, amount, status): whether the database and each expected table are there (1) or not (0)."""
    there = spark.catalog.databaseExists(database)
    found = set(tables(spark, database)) if there else set()
    present = [("database", "", there)] + [("table", name, name in found) for name in expected]
    rows = [(check, name, float(is_there), "PASS" if is_there else "FAIL") for check, name, is_there in present]
    return spark.createDataFrame(rows, "check string, table_name string, amount double, status string")


def partitions(spark: SparkSession, table: str) -> DataFrame:
    """One row for each partition the catalogue knows."""
    return spark.sql(f"SHOW PARTITIONS {table}")


def latest_months(spark: SparkSession, table: str, n: int) -> list[tuple[int, int]]:
    """The n latest (year, month) of a table partitioned by them, from the catalogue alone.

    A month that is registered but holds no rows counts as one of them.
    """
    number = lambda key: F.regexp_extract("partition", rf"{key}=(\d+)", 1).try_cast("int").alias(key)
    months = partitions(spark, table).select(number("rating_year"), number("rating_month")).dropna()
    latest = months.orderBy(F.desc("rating_year"), F.desc("rating_month")).limit(n)
    return [tuple(r) for r in latest.collect()]


def repair_partitions(spark: SparkSession, table: str) -> None:
    """Tell the catalogue of partition folders that were written past it."""
    spark.catalog.recoverPartitions(table)


def text_options() -> str:
    """The CSV options as SQL; a backslash in a SQL string is doubled."""
    options = {"header": "true", **CSV_READ}
    return ", ".join("{} '{}'".format(key, value.replace("\\", "\\\\")) for key, value in options.items())


def register_text_table(spark: SparkSession, name: str, columns: str, path: str) -> DataFrame:
    """An external table over delimited text with one header line."""
    spark.sql(f"CREATE TABLE {name} ({columns}) USING csv OPTIONS ({text_options()}) LOCATION '{path}'")
    return spark.table(name)


def query_views(spark: SparkSession, views: dict[str, DataFrame], sql: str) -> DataFrame:
    """Run SQL over DataFrames named as temporary views."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql)


def strip_qualifier(df: DataFrame) -> DataFrame:
    """Columns named ``table.column``, as some drivers return them, become ``column``."""
    return df.withColumnsRenamed({c: c.rsplit(".", 1)[-1] for c in df.columns if "." in c})
