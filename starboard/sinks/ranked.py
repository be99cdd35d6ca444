"""Lists written for reading by position or by genre."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starboard.functions.text import split_genres
from starboard.operators.paging import Order, all_keys

ROWS_PER_FILE = 1_000_000


def write_ranked(df: DataFrame, order: list[Order], folder: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Write ``df`` in order, and beside it the position (from 0) at which each file starts.

    The columns of ``order`` must identify a row. ``indexed_page`` opens only the files that hold its rows.
    """
    keys = all_keys(order)
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(f"{folder}/rows")
    written = df.sparkSession.read.schema(df.schema).parquet(f"{folder}/rows")
    first = F.min(F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys)))).alias("first")
    files = written.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("rows"), first)
    # One row for each file.
    before = F.sum("rows").over(Window.orderBy("first", "file")) - F.col("rows")
    files.select("file", "rows", before.alias("start")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/positions")


def write_genre_postings(movies: DataFrame, folder: str) -> None:
    """Write the movies of each genre in the order of genres, and the genres there are."""
    genre = F.explode(split_genres(F.col("genres"))).alias("genre")
    found = movies.where("movie_id IS NOT NULL").select(genre, "movie_id").distinct()
    rows = found.repartitionByRange("genre", "movie_id").sortWithinPartitions("genre", "movie_id")
    rows.write.mode("overwrite").parquet(f"{folder}/postings")
    written = movies.sparkSession.read.schema(found.schema).parquet(f"{folder}/postings")
    written.select("genre").distinct().coalesce(1).write.mode("overwrite").parquet(f"{folder}/genres")
