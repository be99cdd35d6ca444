"""Frames for the serving tables, and the queries that read them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starboard.functions.text import genre_matches, genres_label, split_genres, year_label
from starboard.operators.joins import known_items, with_stats_filled
from starboard.operators.cleaning import one_row_per_item
from starboard.operators.paging import Order, all_keys, indexed_page, numbered_page, page_after
from starboard.schemas import GENRE_SEPARATOR, PAGE_SIZE


def score_order(recommendations: DataFrame) -> list[Order]:
    """Best score first; ids settle equal scores."""
    ids = [Order(c) for c in ("movie_id", "user_id") if c in recommendations.columns]
    return [Order("recommendation_score", descending=True), *ids]


def serving_movies(movies: DataFrame, stats: DataFrame) -> DataFrame:
    """Every movie with its statistics, 0 where it has none."""
    return with_stats_filled(movies, stats).select(
        F.col("movieId").alias("movie_id"),
        "title",
        "genres",
        "year",
        F.col("avg_rating").cast("float").alias("avg_rating"),
        F.col("rating_count").cast("int").alias("rating_count"),
    )


def serving_top(top: DataFrame) -> DataFrame:
    """A Bayesian top list as recommendations for everyone."""
    return top.select(
        F.col("movieId").alias("movie_id"),
        F.col("weighted_rating").alias("recommendation_score"),
        F.col("avg_rating").alias("popularity_score"),
    )


def prepare_serving_frames(movies: DataFrame, stats: DataFrame, top: DataFrame) -> tuple[DataFrame, DataFrame]:
    return serving_movies(movies, stats), serving_top(top)


def imported_movies(movie_statistics: DataFrame) -> DataFrame:
    """Serving movies from a statistics file: one row for each id, no NULL genres."""
    return one_row_per_item(movie_statistics).select(
        F.col("movieId").alias("movie_id"),
        "title",
        genres_label(F.col("genres")).alias("genres"),
        "year",
        "avg_rating",
        F.col("rating_count").cast("int").alias("rating_count"),
    )


def imported_recommendations(recommendations: DataFrame, movies: DataFrame) -> DataFrame:
    """Recommendations whose movie exists; popularity is the movie's average."""
    averages = movies.select("movie_id", F.col("avg_rating").alias("popularity_score"))
    return recommendations.withColumnRenamed("movieId", "movie_id").join(averages, "movie_id").select(
        "movie_id",
        F.col("userId").alias("user_id"),
        F.col("predicted_rating").cast("double").alias("recommendation_score"),
        "popularity_score",
    )


def recommendations_of_known(top: DataFrame, movies: DataFrame) -> DataFrame:
    return known_items(serving_top(top), movies, "movie_id")


def lookup_movies(recommendations: DataFrame, movies: DataFrame) -> DataFrame:
    return recommendations.join(movies, "movie_id")


def user_filter(recommendations: DataFrame, user: int) -> DataFrame:
    return recommendations.where(F.col("user_id") == user)


def genre_filter(rows: DataFrame, needle: str) -> DataFrame:
    return rows.where(genre_matches(F.col("genres"), needle)) if needle else rows


def movies_of_genre(movies: DataFrame, folder: str, needle: str) -> DataFrame:
    """Ids of the movies that ``genre_filter`` finds, from ``write_genre_postings``.

    Genres are few: the search goes through their names, and only the postings of those it finds are read. What goes
    beyond one genre's name can't be found there and is looked up in the movies.
    """
    if not needle or GENRE_SEPARATOR in needle:
        return genre_filter(movies, needle).select("movie_id").distinct()
    spark = movies.sparkSession
    names = spark.read.schema("genre string").parquet(f"{folder}/genres").where(genre_matches(F.col("genre"), needle))
    found = spark.read.parquet(f"{folder}/postings").where(F.col("genre").isin([r["genre"] for r in names.collect()]))
    return found.select("movie_id").distinct()


def user_top_n(recommendations: DataFrame, movies: DataFrame, user: int, n: int = 10) -> DataFrame:
    """One user's n best recommendations; the list is cut before the movies are looked up."""
    best = user_filter(recommendations, user).join(movies.select("movie_id"), "movie_id", "left_semi")
    best = best.orderBy(F.desc("recommendation_score"), "movie_id").limit(n)
    return (
        lookup_movies(best, movies)
        .orderBy(F.desc("recommendation_score"), "movie_id")
        .select(
            "movie_id",
            "title",
            "genres",
            "year",
            F.round("recommendation_score", 2).alias("predicted_rating"),
            F.round("avg_rating", 2).alias("avg_rating"),
            "rating_count",
        )
    )


def recommendation_page(
    recommendations: DataFrame, movies: DataFrame, page, genre: str = "", size: int = PAGE_SIZE, postings: str | None = None
):
    """A numbered page of the recommendations, of one genre if one is given; ``postings`` names its index, if there is one."""
    if genre:
        wanted = movies_of_genre(movies, postings, genre) if postings else genre_filter(movies, genre).select("movie_id")
        recommendations = recommendations.join(wanted, "movie_id", "left_semi")
    rows = numbered_page(recommendations, score_order(recommendations), page, size)
    return lookup_movies(rows, movies)


def ranked_page(recommendations: DataFrame, movies: DataFrame, folder: str, page, size: int = PAGE_SIZE) -> DataFrame:
    """A numbered page of all recommendations, as ``write_ranked`` left them in ``folder``."""
    spark, order = movies.sparkSession, score_order(recommendations)
    rows = indexed_page(spark, folder, order, page, size).select(*recommendations.columns)
    # At most one page of rows.
    return movies.join(F.broadcast(rows), "movie_id").select(*rows.columns, *(c for c in movies.columns if c != "movie_id"))


def next_page(recommendations: DataFrame, movies: DataFrame, last: list | None, size: int = PAGE_SIZE) -> DataFrame:
    """The page after the row with the values ``last`` (score, movie_id and, if there, user_id)."""
    return lookup_movies(page_after(recommendations, score_order(recommendations), last, size), movies)


def movies_in_order(movies: DataFrame) -> DataFrame:
    return movies.orderBy(F.desc("avg_rating"), F.desc("rating_count"), "movie_id")


def recommendations_in_order(recommendations: DataFrame) -> DataFrame:
    return recommendations.orderBy(*all_keys(score_order(recommendations)))


def dashboard_top(recommendations: DataFrame, movies: DataFrame, n: int = 10) -> DataFrame:
    return lookup_movies(recommendations_in_order(recommendations).limit(n), movies)


def users_preview(recommendations: DataFrame, users: list[int]) -> DataFrame:
    """Some users' lists, each from its best prediction down, in one job."""
    rows = recommendations.where(F.col("userId").isin(users))
    return rows.orderBy("userId", F.desc("predicted_rating"), "movieId")


def distinct_genres(movies: DataFrame) -> DataFrame:
    """All genres in order; movies with NULL or '' genres add none."""
    named = movies.where(F.col("genres") != "")
    return named.select(F.explode(split_genres(F.col("genres"))).alias("genre")).distinct().orderBy("genre")


def dashboard_totals(movies: DataFrame, recommendations: DataFrame, datasets: DataFrame) -> DataFrame:
    counted = movies.agg(
        F.count(F.lit(1)).alias("total_movies"), F.coalesce(F.avg("avg_rating"), F.lit(0.0)).alias("avg_rating")
    )
    files = datasets.agg(
        F.struct(
            F.count(F.lit(1)).alias("total_datasets"), F.count_if(F.col("processed")).alias("processed_datasets")
        )
    )
    return counted.select(
        "total_movies",
        recommendations.agg(F.count(F.lit(1))).scalar().alias("total_recommendations"),
        files.scalar().alias("files"),
        "avg_rating",
    ).select("total_movies", "total_recommendations", "files.*", "avg_rating")


def import_statistics(movies: DataFrame, recommendations: DataFrame) -> DataFrame:
    """Totals after an import, and recommendations for each user (0 when there are none)."""
    counted = recommendations.agg(
        F.count(F.lit(1)).alias("total_recommendations"), F.count_distinct("user_id").alias("unique_users")
    )
    return counted.select(
        movies.agg(F.count(F.lit(1))).scalar().alias("total_movies"),
        "total_recommendations",
        "unique_users",
        F.coalesce(F.try_divide("total_recommendations", "unique_users"), F.lit(0.0)).alias("recs_per_user"),
    )


def display_top(top_rated: DataFrame) -> DataFrame:
    """Years and averages as they are shown: 'N/A' for no year, two decimals."""
    return top_rated.withColumns(
        {"year": year_label(F.col("year")), "avg_rating": F.round("avg_rating", 2)}
    )
