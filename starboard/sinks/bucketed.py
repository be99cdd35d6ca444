"""Catalogue tables that are dealt out once, so that work by their key needs no exchange."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of one bucket, and the least buckets, where their number follows the rows.
BUCKET_ROWS = 4_000_000
LEAST_BUCKETS = 8


def buckets_for(rows: int) -> int:
    """Buckets of about ``BUCKET_ROWS`` at most, if keys are spread evenly."""
    return max(LEAST_BUCKETS, -(-rows // BUCKET_ROWS))


def write_bucketed(
    df: DataFrame, table: str, folder: str, by: Sequence[str], buckets: int | None, sort: Sequence[str] = ()
) -> DataFrame:
    """Write ``df`` as a table in ``folder``, one file for each bucket; return the table.

    A task sorts and later reads a whole bucket. With ``buckets`` None their number follows the rows, which are counted first;
    tables that are to be joined need the same number given.

    Grouping, windows and joins whose keys include all of ``by`` read it without an exchange, joins if the other side has the
    same buckets. A bucket holds whole keys: by item, one with a third of the ratings makes a bucket of a third. Work on
    pairs alone is better dealt by user and item, which splits it.
    """
    buckets = buckets_for(df.count()) if buckets is None else buckets
    rows = df.repartition(buckets, *by)
    writer = rows.write.mode("overwrite").format("parquet").option("path", folder).bucketBy(buckets, *by)
    (writer.sortBy(*sort) if sort else writer).saveAsTable(table)
    return df.sparkSession.table(table)


def distinct_pairs(ratings: DataFrame, user: str = "userId", item: str = "movieId") -> DataFrame:
    """One row: rows, and distinct pairs with neither side NULL, by groups of pairs."""
    groups = ratings.groupBy(user, item).agg(F.count(F.lit(1)).alias("n"))
    known = F.col(user).isNotNull() & F.col(item).isNotNull()
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count_if(known).alias("pairs"))
