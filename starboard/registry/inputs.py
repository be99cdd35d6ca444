"""Inputs that several queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starboard import fixtures
from starboard.operators import cleaning, serving, stats
from starboard.operators.month_state import write_month_state
from starboard.operators.recommend import explode_recommendations
from starboard.schemas import RAW_MOVIES, RAW_RATINGS
from starboard.session import prepared
from starboard.sinks.files import write_table_folder
from starboard.sinks.ranked import write_genre_postings, write_ranked
from starboard.sinks.serving import write_recommendations

# The derived items have 14 to 49 ratings, so the usual thresholds of 100 and 50 would keep none.
M = 30
GENRE_M = 20


def raw_movies(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.raw_movies(spark, sf).to(RAW_MOVIES)


def raw_ratings(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.raw_ratings(spark, sf).to(RAW_RATINGS)


def valid_ratings(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.valid_ratings(raw_ratings(spark, sf))


def latest_ratings(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.dedup_latest(valid_ratings(spark, sf))


def movies_with_year(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.with_year(raw_movies(spark, sf))


def known_movies(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.one_row_per_item(movies_with_year(spark, sf).where(F.col("movieId").isNotNull()))


def cleaned_movies(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.clean_movies(raw_movies(spark, sf))


def cleaned_ratings(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.clean_ratings(raw_ratings(spark, sf))


def item_stats(spark: SparkSession, sf: str) -> DataFrame:
    return stats.item_stats(valid_ratings(spark, sf))


def recommendation_lists(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.recommendation_lists(spark, sf)


def recommendations(spark: SparkSession, sf: str) -> DataFrame:
    return explode_recommendations(recommendation_lists(spark, sf))


def serving_movies(spark: SparkSession, sf: str) -> DataFrame:
    return serving.serving_movies(known_movies(spark, sf), item_stats(spark, sf))


def serving_recommendations(spark: SparkSession, sf: str) -> DataFrame:
    return serving.imported_recommendations(recommendations(spark, sf), serving_movies(spark, sf))


def stored_serving(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Movies and recommendations as written tables, made once for each session and source."""

    def write(folder: str) -> None:
        write_table_folder(serving_movies(spark, sf), f"{folder}/movies")
        movies = spark.read.parquet(f"{folder}/movies")
        found = serving.imported_recommendations(recommendations(spark, sf), movies)
        write_recommendations(found, f"{folder}/recommendation_data")

    folder = prepared(spark, "serving", sf, write)
    return spark.read.parquet(f"{folder}/movies"), spark.read.parquet(f"{folder}/recommendation_data")


def stored_pages(spark: SparkSession, sf: str) -> str:
    """Folder of the stored recommendations in order, with positions, and of the genres' postings."""
    movies, recommendations = stored_serving(spark, sf)

    def write(folder: str) -> None:
        write_ranked(recommendations, serving.score_order(recommendations), f"{folder}/ranked")
        write_genre_postings(movies, f"{folder}/genres")

    return prepared(spark, "pages", sf, write)


def stored_months(spark: SparkSession, sf: str) -> str:
    """Folder of the state of each month of the stored cleaned ratings."""
    return prepared(spark, "months", sf, lambda folder: write_month_state(stored_cleaned(spark, sf)[1], folder, whole_table=True))


def stored_raw(spark: SparkSession, sf: str) -> str:
    """Folder of the raw ratings as a table."""
    return prepared(spark, "raw", sf, lambda folder: write_table_folder(raw_ratings(spark, sf), f"{folder}/ratings"))


def stored_cleaned(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Cleaned movies and ratings as written tables, made once for each session and source."""

    def write(folder: str) -> None:
        write_table_folder(cleaned_movies(spark, sf), f"{folder}/movies")
        write_table_folder(cleaned_ratings(spark, sf), f"{folder}/ratings")

    folder = prepared(spark, "cleaned", sf, write)
    return spark.read.parquet(f"{folder}/movies"), spark.read.parquet(f"{folder}/ratings")


def raw_dataset(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.raw_dataset(spark, sf)
