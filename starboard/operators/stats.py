"""Statistics of ratings: for each item, each user, and the whole table.

Averages and counts combine before the shuffle, so an item with a third of all ratings
costs one row for each task. Distinct users and items are counted as groups, one narrow
pass each, rather than in one pass that would copy every row once for each distinct count.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def item_stats(ratings: DataFrame, item="movieId", value="rating") -> DataFrame:
    return ratings.groupBy(item).agg(F.avg(value).alias("avg_rating"), F.count(value).alias("rating_count"))


def item_stddev(ratings: DataFrame, item="movieId", value="rating") -> DataFrame:
    return ratings.groupBy(item).agg(
        F.avg(value).alias("avg_rating"),
        F.count(value).alias("rating_count"),
        F.stddev(value).alias("rating_stddev"),
    )


def mean_of_means(stats: DataFrame) -> DataFrame:
    """One row: the mean of the items' means. Items without a rating have no mean.

    The test on the count changes no value. It makes this read the same two aggregates as
    the ranking beside it, so that Spark shuffles the ratings once for both.
    """
    rated = F.when(F.col("rating_count") > 0, F.col("avg_rating"))
    return stats.agg(F.avg(rated).alias("mean_rating"))


def distinct_count(df: DataFrame, column: str) -> Column:
    """Scalar: how many non-null values the column has."""
    values = df.where(F.col(column).isNotNull()).select(column).distinct()
    return values.agg(F.count(F.lit(1))).scalar()


def rating_distribution(ratings: DataFrame, value="rating") -> DataFrame:
    return ratings.groupBy(value).agg(F.count(F.lit(1)).alias("count")).orderBy(value)


def most_active_users(ratings: DataFrame, n: int = 10, user="userId") -> DataFrame:
    counts = ratings.groupBy(user).agg(F.count(F.lit(1)).alias("rating_count"))
    return counts.orderBy(F.desc("rating_count"), user).limit(n)


def most_rated_items(ratings: DataFrame, movies: DataFrame, n: int = 10, item="movieId") -> DataFrame:
    counts = ratings.groupBy(item).agg(F.count(F.lit(1)).alias("rating_count"))
    named = counts.join(movies, item).select(item, "title", "year", "rating_count")
    return named.orderBy(F.desc("rating_count"), item).limit(n)


def distinct_users_items(ratings: DataFrame, user="userId", item="movieId") -> DataFrame:
    users = ratings.where(F.col(user).isNotNull()).select(user).distinct()
    return users.agg(F.count(F.lit(1)).alias("unique_users")).withColumn("unique_movies", distinct_count(ratings, item))


def global_counts(movies: DataFrame, ratings: DataFrame) -> DataFrame:
    """Valid movies, valid ratings, their users and their average (0 when there are none)."""
    valid_movies = movies.where(F.col("is_valid")).agg(F.count(F.lit(1)))
    per_user = (
        ratings.where(F.col("is_valid"))
        .groupBy("userId")
        .agg(F.count(F.lit(1)).alias("n"), F.count("rating").alias("rated"), F.sum("rating").alias("total"))
    )
    return per_user.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("ratings_count"),
        F.count("userId").alias("users_count"),
        F.coalesce(F.try_divide(F.sum("total"), F.sum("rated")), F.lit(0.0)).alias("avg_rating"),
    ).select(valid_movies.scalar().alias("movies_count"), "ratings_count", "users_count", "avg_rating")
