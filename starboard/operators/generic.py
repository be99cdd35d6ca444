"""Cleaning of any table, whatever its columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def drop_all_null(df: DataFrame) -> DataFrame:
    return df.dropna(how="all")


def fill_unknown(df: DataFrame, label: str = "Unknown") -> DataFrame:
    columns = string_columns(df)
    return df.fillna(label, subset=columns) if columns else df


def trim_strings(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.trim(F.col(c)) for c in string_columns(df)})


def clean_any(df: DataFrame) -> DataFrame:
    """Duplicates out, empty rows out, missing strings 'Unknown', strings trimmed - in that order.

    So rows that are equal only once trimmed stay apart, and blank strings become ''.
    """
    return trim_strings(fill_unknown(drop_all_null(drop_duplicate_rows(df))))


def clean_counts(df: DataFrame) -> DataFrame:
    """One row: what ``clean_any`` reads, removes and returns.

    An aggregate of its own and not counters beside the cleaning: those would count again the
    rows of a task that runs twice because its executor was lost.
    """
    empty = reduce(Column.__and__, [F.col(c).isNull() for c in df.columns])
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
    return groups.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("input_rows"),
        F.count(F.lit(1)).alias("distinct_rows"),
        F.count_if(empty).alias("empty_rows_removed"),
    ).select(
        "input_rows",
        (F.col("input_rows") - F.col("distinct_rows")).alias("duplicates_removed"),
        "empty_rows_removed",
        (F.col("distinct_rows") - F.col("empty_rows_removed")).alias("output_rows"),
        F.lit(len(df.columns)).alias("column_number"),
    )


def map_to_recommendation(df: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Rename columns to item_id, item_name, category, score and description; no mapping, no change."""
    if not mapping:
        return df
    targets = ["item_id", "item_name", "category", "score", "description"]
    unknown = sorted(set(mapping) - set(targets))
    if unknown:
        raise ValueError(f"not a recommendation column: {unknown}")
    return df.select(*[F.col(mapping[t]).alias(t) for t in targets if t in mapping])
