"""Cleaning of movies and ratings."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starboard.functions.text import split_genres, year_anchored, year_anywhere
from starboard.functions.time import rating_date, rating_month, rating_year
from starboard.functions.validity import movie_is_valid, rating_is_valid
from starboard.schemas import CLEANED_MOVIES, CLEANED_RATINGS, MAX_RATING, MIN_RATING


def with_year(movies: DataFrame) -> DataFrame:
    return movies.withColumn("year", year_anywhere(F.col("title")))


def valid_ratings(ratings: DataFrame, user="userId", item="movieId", value="rating", time="timestamp") -> DataFrame:
    """Rows with all four columns present and the rating in range.

    Written as a plain conjunction, so that the null tests and the range reach the scan.
    """
    return ratings.where(
        F.col(user).isNotNull()
        & F.col(item).isNotNull()
        & F.col(value).isNotNull()
        & F.col(time).isNotNull()
        & F.col(value).between(MIN_RATING, MAX_RATING)
    )


def dedup_latest(ratings: DataFrame, user="userId", item="movieId", value="rating", time="timestamp") -> DataFrame:
    """One row for each (user, item): the latest, and of equally late ones the highest.

    Spark keeps the first row of each pair before the shuffle as well as after it
    (WindowGroupLimit), so a pair with very many copies never lands in one task.
    """
    newest = Window.partitionBy(user, item).orderBy(F.desc(time), F.desc(value))
    return ratings.withColumn("_position", F.row_number().over(newest)).where(F.col("_position") == 1).drop("_position")


def clean_movies(raw: DataFrame) -> DataFrame:
    """Rows without an id go; all others stay, flagged valid or not. Duplicate ids stay too."""
    return raw.where(F.col("movieId").isNotNull()).select(
        "movieId",
        F.trim("title").alias("title"),
        year_anchored(F.col("title")).alias("year"),
        split_genres(F.col("genres")).alias("genres_array"),
        "genres",
        movie_is_valid(F.col("movieId"), F.col("title"), F.col("genres")).alias("is_valid"),
    ).to(CLEANED_MOVIES)


def derived_columns() -> dict[str, Column]:
    """The columns of cleaned ratings that follow from the narrow ones."""
    seconds = F.col("timestamp")
    return {
        "rating_date": rating_date(seconds),
        "is_valid": rating_is_valid(F.col("userId"), F.col("movieId"), F.col("rating"), seconds),
    }


def clean_ratings(raw: DataFrame, dedup: bool = True) -> DataFrame:
    """Valid ratings with their date and the year and month they are partitioned by."""
    kept = valid_ratings(raw)
    if dedup:
        kept = dedup_latest(kept)
    seconds, derived = F.col("timestamp"), derived_columns()
    return kept.select(
        "userId",
        "movieId",
        "rating",
        derived["rating_date"].alias("rating_date"),
        "timestamp",
        derived["is_valid"].alias("is_valid"),
        rating_year(seconds).alias("rating_year"),
        rating_month(seconds).alias("rating_month"),
    ).to(CLEANED_RATINGS)


def one_row_per_item(movies: DataFrame, item: str = "movieId") -> DataFrame:
    """The first row of each item in the order of its other columns (NULL first)."""
    others = [F.asc_nulls_first(c) for c in movies.columns if c != item]
    first = Window.partitionBy(item).orderBy(*others)
    return movies.withColumn("_position", F.row_number().over(first)).where(F.col("_position") == 1).drop("_position")
