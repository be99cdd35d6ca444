"""The five warehouse tables and their maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from starboard.schemas import (
    CLEANED_MOVIES,
    CLEANED_RATINGS,
    QUALITY_REPORT,
    RATING_PARTITIONS,
    RAW_MOVIES,
    RAW_RATINGS,
)
from starboard.sinks.files import PARQUET_TUNING, write_partitioned
from starboard.sources.catalog import repair_partitions, text_options

TABLES = {
    "raw_movies": RAW_MOVIES,
    "raw_ratings": RAW_RATINGS,
    "cleaned_movies": CLEANED_MOVIES,
    "cleaned_ratings": CLEANED_RATINGS,
    "data_quality_report": QUALITY_REPORT,
}
PARTITIONED = {"cleaned_ratings": RATING_PARTITIONS}
TEXT = {"raw_movies", "raw_ratings"}


def _columns(name: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in TABLES[name].fields)


def create_tables(spark: SparkSession, database: str, folder: str) -> None:
    """Drop and create the database's tables over ``folder``: raw ones as text, others as Parquet.

    Dropping forgets the table only; its files stay, as the tables are external.
    """
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{folder}'")
    for name in TABLES:
        kind = f"csv OPTIONS ({text_options()})" if name in TEXT else "parquet"
        by = f"PARTITIONED BY ({', '.join(PARTITIONED[name])})" if name in PARTITIONED else ""
        spark.sql(f"DROP TABLE IF EXISTS {database}.{name}")
        spark.sql(
            f"CREATE TABLE {database}.{name} ({_columns(name)}) USING {kind} {by} LOCATION '{folder}/{name}'"
        )


def table_folder(folder: str, name: str) -> str:
    return f"{folder}/{name}"


def overwrite_table(df: DataFrame, table: str) -> None:
    df.write.insertInto(table, overwrite=True)


def append_table(df: DataFrame, table: str) -> None:
    df.write.insertInto(table)


def load_cleaned_ratings(
    spark: SparkSession, cleaned: DataFrame, database: str, folder: str, derived: dict[str, Column] | None = None
) -> None:
    """Replace the whole table, months that no longer occur included, and its partitions in the catalogue.

    ``derived`` as in ``write_partitioned``.
    """
    path = table_folder(folder, "cleaned_ratings")
    write_partitioned(cleaned, path, options=PARQUET_TUNING, whole_table=True, derived=derived)
    repair_partitions(spark, f"{database}.cleaned_ratings")
