"""Counts, nulls and ranges from the footers of Parquet files, without reading rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def footer_totals(spark: SparkSession, path: str, columns: Sequence[str], ranges: Sequence[str] = ()) -> DataFrame:
    """One row: ``rows``, ``null_<column>`` for ``columns``, and ``min_`` and ``max_`` for the numbers in ``ranges``.

    Spark answers such aggregates from footers if the scan is of its second version and nothing filters it; a session of
    its own has these settings, so that the caller's stay as they are.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.sources.useV1SourceList", "avro,csv,json,kafka,orc,text")
    session.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    counts = [F.count(c).alias(f"with_{c}") for c in columns]
    edges = [f(c).alias(f"{name}_{c}") for c in ranges for name, f in (("min", F.min), ("max", F.max))]
    found = session.read.parquet(path).agg(F.count(F.lit(1)).alias("rows"), *counts, *edges)
    def number(name: str) -> Column:
        # Files without a row group add nothing instead of 0, though Spark takes a count to be never null.
        return F.when(F.col(name) >= 0, F.col(name)).otherwise(F.lit(0))

    nulls = [(number("rows") - number(f"with_{c}")).alias(f"null_{c}") for c in columns]
    # A least value of 0 is -0.0 in a footer.
    shown = [(F.col(f"{name}_{c}") + F.lit(0)).alias(f"{name}_{c}") for c in ranges for name in ("min", "max")]
    return found.select(number("rows").alias("rows"), *nulls, *shown)
