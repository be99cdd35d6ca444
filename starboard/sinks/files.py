"""CSV, Parquet and ORC files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starboard.schemas import CSV_WRITE, RATING_PARTITIONS

# 128 MB row groups, 1 MB pages, at most 8 MB of padding.
PARQUET_TUNING = {
    "parquet.block.size": "134217728",
    "parquet.page.size": "1048576",
    "parquet.writer.max-padding": "8388608",
}


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header line, replacing what is there.

    Each partition is a file, so a top list, which is one partition by itself, is one file.
    """
    df.write.mode("overwrite").option("header", True).options(**CSV_WRITE).csv(path)


def write_table_folder(df: DataFrame, path: str, format: str = "parquet", mode: str = "overwrite") -> None:
    df.write.mode(mode).format(format).save(path)


def write_partitioned(
    ratings: DataFrame,
    path: str,
    columns: list[str] = RATING_PARTITIONS,
    format: str = "parquet",
    options: dict[str, str] | None = None,
    whole_table: bool = False,
    derived: dict[str, Column] | None = None,
) -> None:
    """Write by partition: the whole table anew, or only the partitions that occur in ``ratings``.

    Replacing single partitions is for increments. Partitions absent from ``ratings`` stay as
    they are, and pairs repeated between an increment and what stays are not removed. Rows of
    one partition are brought together to save small files; AQE cuts a partition that holds
    much of the data into several tasks. Columns in ``derived`` follow from the others by the
    expressions given; they are left out of that exchange and computed after it.
    """
    derived = derived or {}
    rows = ratings.drop(*derived).hint("rebalance", *[F.col(c) for c in columns])
    (
        rows.withColumns(derived)
        .select(*ratings.columns)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static" if whole_table else "dynamic")
        .options(**(options or {}))
        .partitionBy(*columns)
        .format(format)
        .save(path)
    )


def export_valid_csv(cleaned: DataFrame, path: str, columns: list[str]) -> None:
    """Valid rows with the given columns; arrays have no CSV form and must be left out."""
    write_csv(cleaned.where(F.col("is_valid")).select(*columns), path)


def write_user_range(recommendations: DataFrame, path: str, first_user: int, last_user: int) -> None:
    """The recommendations of the users from ``first_user`` to ``last_user``."""
    write_csv(recommendations.where(F.col("userId").between(first_user, last_user)), path)
