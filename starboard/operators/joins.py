"""Joins of ratings, statistics and recommendations with the movies.

Ratings are always reduced to one row for each item first, so no join carries a hot item's
rows. Recommendations cannot be reduced; there, and only there, a hot item's rows meet the
join, where AQE splits an oversized partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starboard.functions.text import genre_matches

BROADCAST_LIMIT = 64 * 1024 * 1024


def with_stats(movies: DataFrame, stats: DataFrame, item="movieId") -> DataFrame:
    return movies.join(stats, item, "inner")


def with_stats_filled(movies: DataFrame, stats: DataFrame, item="movieId") -> DataFrame:
    return movies.join(stats, item, "left").fillna({"avg_rating": 0.0, "rating_count": 0})


def rated_items(ratings: DataFrame, item="movieId") -> DataFrame:
    return ratings.where(F.col(item).isNotNull()).select(item).distinct()


def orphan_items(ratings: DataFrame, movies: DataFrame, item="movieId") -> DataFrame:
    """Rated items that no movie row has."""
    return rated_items(ratings, item).join(movies.select(item), item, "left_anti")


def grouped_by_movie(movies: DataFrame, ratings: DataFrame, dims: list[str], item="movieId") -> DataFrame:
    """Count and average of the ratings for each distinct combination of the movie columns.

    Gives what joining first and grouping afterwards would give, repeated movie rows
    included, but joins two reduced sides.
    """
    keys = [item] + [d for d in dims if d != item]
    per_item = ratings.groupBy(item).agg(F.count("rating").alias("_n"), F.sum("rating").alias("_total"))
    per_movie = movies.groupBy(*keys).agg(F.count(F.lit(1)).alias("_copies"))
    return per_movie.join(per_item, item).select(
        *keys,
        (F.col("_n") * F.col("_copies")).alias("rating_count"),
        F.try_divide("_total", "_n").alias("avg_rating"),
    )


def valid_left_join_counts(movies: DataFrame, ratings: DataFrame, m: int, n: int) -> DataFrame:
    """A left join from movies whose filter on the right side makes it an inner one."""
    per_item = ratings.groupBy("movieId", "is_valid").agg(
        F.count("rating").alias("_n"), F.sum("rating").alias("_total")
    )
    per_movie = movies.groupBy("movieId", "title", "year", "is_valid").agg(F.count(F.lit(1)).alias("_copies"))
    joined = per_movie.alias("m").join(per_item.alias("r"), "movieId", "left")
    return (
        joined.where(F.col("m.is_valid") & F.col("r.is_valid"))
        .select(
            "movieId",
            "title",
            "year",
            (F.col("_n") * F.col("_copies")).alias("rating_count"),
            F.try_divide("_total", "_n").alias("avg_rating"),
        )
        .where(F.col("rating_count") >= m)
        .orderBy(F.desc("avg_rating"), "movieId")
        .limit(n)
    )


def recommendations_with_movies(recommendations: DataFrame, movies: DataFrame) -> DataFrame:
    """``movies`` must hold each id once, or recommendations would multiply."""
    return recommendations.join(movies, "movieId").select(
        "userId", "movieId", "title", "year", "genres", "predicted_rating"
    )


def recommendations_of_genre(session: SparkSession, recommendations: str, movies: str, needle: str) -> DataFrame:
    """Recommendations of the movies whose genres hold ``needle``, from the two tables' folders.

    In a ``filtering_session`` the recommendations are filtered by the movies' ids in their scan, so that only those of
    the genre, and a few by chance, are shuffled.
    """
    wanted = session.read.parquet(movies).where(genre_matches(F.col("genres"), needle))
    rows = session.read.parquet(recommendations)
    return rows.join(wanted.select("movie_id", "title"), "movie_id").select("user_id", "movie_id", "title", "recommendation_score")


def known_items(rows: DataFrame, movies: DataFrame, item="movieId") -> DataFrame:
    return rows.join(movies.select(item), item, "left_semi")


def count_unknown_items(rows: DataFrame, movies: DataFrame, item="movieId") -> DataFrame:
    """How many rows have an item that no movie row has (a NULL item is one)."""
    per_item = rows.groupBy(item).agg(F.count(F.lit(1)).alias("_rows"))
    skipped = per_item.join(movies.select(item), item, "left_anti")
    return skipped.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("skipped"))


def attach_scalar(df: DataFrame, one_row: DataFrame, name: str) -> DataFrame:
    """Add the single value of ``one_row`` to every row, as a scalar subquery."""
    return df.withColumn(name, one_row.scalar())


def _width(field: T.StructField) -> Column:
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(field.name), F.lit(0)) + 16
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(field.name))), F.lit(0)) + 16
    return F.lit(16)


def measured_bytes(df: DataFrame) -> int:
    """Size of the rows, from one aggregate over all of them."""
    widths = [_width(f) for f in df.schema.fields]
    total = sum(widths[1:], widths[0])
    return df.agg(F.sum(total.cast("long"))).first()[0] or 0


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Mark the side for broadcast only when its measured size is within the limit.

    Beyond it the side is returned as it is, and Spark shuffles both. Measuring reads the side
    once more, so a costly one should be a written table.
    """
    return F.broadcast(df) if measured_bytes(df) <= limit else df


def join_broadcast_hint(movies: DataFrame, stats: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    return movies.join(broadcast_if_small(stats, limit), "movieId", "left")
