"""Serving tables: each refilled as a whole by one distributed write, and all replaced at once (see ``versions``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starboard.functions.text import genres_label
from starboard.operators.joins import count_unknown_items
from starboard.operators.serving import imported_movies, imported_recommendations, recommendations_of_known
from starboard.sinks.files import write_table_folder
from starboard.sinks.versions import commit, current, new_version

MOVIES = "movies"
RECOMMENDATIONS = "recommendation_data"


def read_serving(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Both tables of the current version."""
    tables = current(spark, folder)
    return spark.read.parquet(tables[MOVIES]), spark.read.parquet(tables[RECOMMENDATIONS])


def write_recommendations(recommendations: DataFrame, path: str) -> None:
    """Write personal recommendations in the order of users, best first.

    A user's rows are then in one file or a few, and a query for one user opens only those.
    The score and the movie are part of the ranges, so a user with very many rows is split.
    """
    order = ["user_id", F.desc("recommendation_score"), "movie_id"]
    write_table_folder(recommendations.repartitionByRange(*order).sortWithinPartitions(*order), path)


def refresh_serving(movies: DataFrame, top: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Write all movies, and those of ``top`` whose movie is among them, as a new version; return both as written."""
    spark = movies.sparkSession
    version = new_version(spark, folder)
    movies = movies.withColumn("genres", genres_label(F.col("genres")))
    write_table_folder(movies, f"{version}/{MOVIES}")
    written = spark.read.parquet(f"{version}/{MOVIES}")
    write_table_folder(recommendations_of_known(top, written), f"{version}/{RECOMMENDATIONS}")
    commit(spark, folder, version, [MOVIES, RECOMMENDATIONS])
    return read_serving(spark, folder)


def load_als_serving(
    movie_statistics: DataFrame, recommendations: DataFrame, folder: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Write movies and personal recommendations as a new version; return both, and the count of those skipped."""
    spark = movie_statistics.sparkSession
    version = new_version(spark, folder)
    write_table_folder(imported_movies(movie_statistics), f"{version}/{MOVIES}")
    movies = spark.read.parquet(f"{version}/{MOVIES}")
    write_recommendations(imported_recommendations(recommendations, movies), f"{version}/{RECOMMENDATIONS}")
    commit(spark, folder, version, [MOVIES, RECOMMENDATIONS])
    skipped = count_unknown_items(recommendations.withColumnRenamed("movieId", "movie_id"), movies, "movie_id")
    return *read_serving(spark, folder), skipped
