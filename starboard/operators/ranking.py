"""Ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starboard.functions.scores import bayesian_score, log_blend_score
from starboard.functions.text import split_genres
from starboard.operators.joins import grouped_by_movie, with_stats
from starboard.operators.stats import mean_of_means
from starboard.schemas import GENRE_MIN_RATINGS, GENRE_TOP_K, TOP_MIN_RATINGS, TOP_N

GROUP_LIMIT_SETTING = "spark.sql.optimizer.windowGroupLimitThreshold"


def min_count_filter(stats: DataFrame, m: int) -> DataFrame:
    return stats.where(F.col("rating_count") >= m)


def with_bayesian_score(rows: DataFrame, stats: DataFrame, m: int = TOP_MIN_RATINGS) -> DataFrame:
    """Score rows by their average and count; the prior is the mean over all of ``stats``."""
    prior = mean_of_means(stats).scalar()
    return rows.withColumn("weighted_rating", bayesian_score(F.col("avg_rating"), F.col("rating_count"), m, prior))


def bayesian_scores(stats: DataFrame, m: int = TOP_MIN_RATINGS) -> DataFrame:
    return with_bayesian_score(min_count_filter(stats, m), stats, m)


def bayesian_top_n(movies: DataFrame, stats: DataFrame, m: int = TOP_MIN_RATINGS, n: int = TOP_N) -> DataFrame:
    scored = with_bayesian_score(min_count_filter(with_stats(movies, stats), m), stats, m)
    return scored.orderBy(F.desc("weighted_rating"), "movieId").limit(n)


def log_blend_top_n(movies: DataFrame, stats: DataFrame, n: int = TOP_N) -> DataFrame:
    score = log_blend_score(F.col("avg_rating"), F.col("rating_count"))
    scored = with_stats(movies, stats).withColumn("recommendation_score", score)
    return scored.orderBy(F.desc("recommendation_score"), "movieId").limit(n)


def top_rated_simple(movie_statistics: DataFrame, m: int = TOP_MIN_RATINGS, n: int = 20) -> DataFrame:
    return min_count_filter(movie_statistics, m).orderBy(F.desc("avg_rating"), "movieId").limit(n)


def top_rated_having(movies: DataFrame, ratings: DataFrame, m: int = TOP_MIN_RATINGS, n: int = 10) -> DataFrame:
    """The best of the valid movies that have at least m valid ratings."""
    grouped = grouped_by_movie(
        movies.where(F.col("is_valid")), ratings.where(F.col("is_valid")), ["movieId", "title", "year", "genres"]
    )
    return min_count_filter(grouped, m).orderBy(F.desc("avg_rating"), "movieId").limit(n)


def explode_genres(movies: DataFrame) -> DataFrame:
    """One row for each (movie, genre); takes genres as an array if there is one, else the text."""
    genres = F.col("genres_array") if "genres_array" in movies.columns else split_genres(F.col("genres"))
    return movies.withColumn("genre", F.explode(genres))


def top_k_per_group(df: DataFrame, group: str, order: list, k: int, key: str) -> DataFrame:
    """The first k rows of each group, with their rank.

    Up to the session's limit (1000 by default) Spark drops the rows beyond k before the
    shuffle. A larger k would sort a whole group in one task, so there the groups are first
    cut into slices, ranked, and only each slice's first k rows go on.
    """
    threshold = int(df.sparkSession.conf.get(GROUP_LIMIT_SETTING, "1000"))
    if k > threshold:
        slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
        df = df.withColumn("_slice", F.pmod(F.xxhash64(key), F.lit(slices)))
        within = Window.partitionBy(group, "_slice").orderBy(*order)
        df = df.withColumn("rank", F.row_number().over(within)).where(F.col("rank") <= k).drop("_slice", "rank")
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(
        F.col("rank") <= k
    )


def genre_top_k(
    movies: DataFrame, stats: DataFrame, m: int = GENRE_MIN_RATINGS, k: int = GENRE_TOP_K
) -> DataFrame:
    """The best k movies of each genre."""
    rated = explode_genres(with_stats(movies, min_count_filter(stats, m)))
    order = [F.desc("avg_rating"), F.desc("rating_count"), F.asc("movieId")]
    columns = [c for c in ["movieId", "title", "genre", "year", "avg_rating", "rating_count", "rank"]]
    ranked = top_k_per_group(rated, "genre", order, k, "movieId")
    return ranked.select(*[c for c in columns if c in ranked.columns])


def genre_count(genre_recommendations: DataFrame) -> DataFrame:
    return genre_recommendations.agg(F.count_distinct("genre").alias("genre_count"))
