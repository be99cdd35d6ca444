"""Raw tables to a checked, cleaned warehouse, and recommendations from it."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starboard.operators.cleaning import clean_movies, clean_ratings, derived_columns, one_row_per_item
from starboard.operators.quality import (
    before_after_compare,
    movie_quality,
    quality_summary,
    rating_quality,
    ratings_by_month,
    verification_report,
)
from starboard.operators.ranking import bayesian_top_n, genre_top_k
from starboard.operators.stats import item_stats
from starboard.schemas import GENRE_MIN_RATINGS, GENRE_TOP_K, TOP_MIN_RATINGS, TOP_N
from starboard.plans.recommendations import written
from starboard.sinks.files import write_csv
from starboard.sinks.tables import (
    TABLES,
    append_table,
    create_tables,
    load_cleaned_ratings,
    overwrite_table,
    table_folder,
)
from starboard.sources.catalog import latest_months, valid_table, verify_catalog


@dataclass
class Warehouse:
    spark: SparkSession
    database: str
    folder: str

    def table(self, name: str) -> DataFrame:
        return self.spark.table(f"{self.database}.{name}")

    def ratings_by_month(self, n: int = 20) -> DataFrame:
        """The latest n months; the catalogue names them, so no other month is read."""
        months = latest_months(self.spark, f"{self.database}.cleaned_ratings", n)
        wanted = reduce(
            Column.__or__,
            [(F.col("rating_year") == y) & (F.col("rating_month") == m) for y, m in months],
            F.lit(False),
        )
        return ratings_by_month(self.table("cleaned_ratings").where(wanted), n)

    def verification(self) -> DataFrame:
        checks = verify_catalog(self.spark, self.database, list(TABLES))
        return checks.unionByName(
            verification_report(
                self.table("raw_movies"),
                self.table("raw_ratings"),
                self.table("cleaned_movies"),
                self.table("cleaned_ratings"),
            )
        )

    def comparison(self) -> DataFrame:
        return before_after_compare(
            self.table("raw_movies"),
            self.table("cleaned_movies"),
            self.table("raw_ratings"),
            self.table("cleaned_ratings"),
        )


def build_warehouse(
    spark: SparkSession, raw_movies: DataFrame, raw_ratings: DataFrame, database: str, folder: str
) -> Warehouse:
    """Upload, create the tables, check the raw data, clean it.

    A second run replaces every table as a whole, so it depends on its own input only.
    """
    write_csv(raw_movies, table_folder(folder, "raw_movies"))
    write_csv(raw_ratings, table_folder(folder, "raw_ratings"))
    create_tables(spark, database, folder)
    warehouse = Warehouse(spark, database, folder)
    movies, ratings = warehouse.table("raw_movies"), warehouse.table("raw_ratings")
    overwrite_table(movie_quality(movies), f"{database}.data_quality_report")
    append_table(rating_quality(ratings), f"{database}.data_quality_report")
    overwrite_table(clean_movies(movies), f"{database}.cleaned_movies")
    load_cleaned_ratings(spark, clean_ratings(ratings), database, folder, derived_columns())
    return warehouse


def warehouse_recommendations(
    spark: SparkSession,
    database: str,
    folder: str,
    m: int = TOP_MIN_RATINGS,
    n: int = TOP_N,
    genre_m: int = GENRE_MIN_RATINGS,
    genre_k: int = GENRE_TOP_K,
    csv: bool = True,
) -> dict[str, DataFrame]:
    """Bayesian top list and best of each genre from the valid rows of a warehouse."""
    movies = valid_table(
        spark, f"{database}.cleaned_movies", ["movieId", "title", "year", "genres", "genres_array", "is_valid"]
    )
    ratings = valid_table(
        spark,
        f"{database}.cleaned_ratings",
        ["userId", "movieId", "rating", "rating_date", "timestamp", "is_valid"],
    )
    # Both lists read the statistics; written once, they cost one pass over the ratings.
    stats = written(item_stats(ratings), f"{folder}/item_stats")
    known = one_row_per_item(movies)
    top = written(bayesian_top_n(known, stats, m, n).drop("genres_array", "is_valid"), f"{folder}/best_movies")
    genres = written(genre_top_k(known, stats, genre_m, genre_k), f"{folder}/best_by_genre")
    if csv:
        write_csv(top, f"{folder}/top_movies")
        write_csv(genres, f"{folder}/best_by_genre_csv")
    return {
        "movies": movies,
        "ratings": ratings,
        "summary": quality_summary(movies, ratings),
        "stats": stats,
        "top_movies": top,
        "genre_recommendations": genres,
    }
