"""CSV files to recommendations and serving tables."""

from __future__ import annotations

from pyspark.ml.recommendation import ALSModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starboard.operators.cleaning import dedup_latest, one_row_per_item, valid_ratings
from starboard.operators.generic import clean_any, map_to_recommendation
from starboard.operators.joins import recommendations_with_movies, with_stats
from starboard.operators.ranking import bayesian_top_n, top_rated_simple
from starboard.operators.recommend import als_fit, als_recommend_all, als_rmse, train_test_split
from starboard.operators.serving import prepare_serving_frames, serving_movies
from starboard.operators.stats import item_stats, most_active_users, rating_distribution
from starboard.schemas import TOP_MIN_RATINGS, TOP_N
from starboard.session import let_go
from starboard.sinks.files import write_csv, write_table_folder
from starboard.sinks.jdbc import write_jdbc
from starboard.sinks.serving import refresh_serving
from starboard.sources.files import read_csv, read_movies, read_ratings


def _known_movies(movies: DataFrame) -> DataFrame:
    """Movies with an id, each id once."""
    return one_row_per_item(movies.where(F.col("movieId").isNotNull()))


def written(df: DataFrame, path: str) -> DataFrame:
    """The rows as a table: who reads them again does not compute them again. What was shuffled for them goes."""
    write_table_folder(df, path)
    rows = df.sparkSession.read.parquet(path)
    let_go(df.sparkSession)
    return rows


def csv_recommendations(
    spark: SparkSession,
    data_folder: str,
    folder: str,
    jdbc: dict | None = None,
    csv: bool = True,
    m: int = TOP_MIN_RATINGS,
    n: int = TOP_N,
) -> dict[str, DataFrame]:
    """movies.csv and ratings.csv to a Bayesian top list and the frames for serving.

    ``jdbc`` holds ``url`` and ``properties`` of the database that gets the movies.
    """
    movies = _known_movies(read_movies(spark, f"{data_folder}/movies.csv"))
    stats = written(item_stats(read_ratings(spark, f"{data_folder}/ratings.csv")), f"{folder}/item_stats")
    frames = prepare_serving_frames(movies, stats, bayesian_top_n(movies, stats, m, n))
    movie_frame = written(frames[0], f"{folder}/movies")
    top_frame = written(frames[1], f"{folder}/recommendations")
    if csv:
        write_csv(movie_frame, f"{folder}/movies_processed")
        write_csv(top_frame, f"{folder}/recommendations_processed")
    if jdbc:
        write_jdbc(movie_frame, jdbc["url"], "movies", jdbc.get("properties"))
    return {"movies": movie_frame, "recommendations": top_frame, "stats": stats}


def serving_refresh(
    spark: SparkSession, data_folder: str, folder: str, m: int = TOP_MIN_RATINGS, n: int = TOP_N
) -> tuple[DataFrame, DataFrame]:
    """movies.csv and ratings.csv to refilled serving tables."""
    movies = _known_movies(read_movies(spark, f"{data_folder}/movies.csv"))
    stats = written(item_stats(read_ratings(spark, f"{data_folder}/ratings.csv")), f"{folder}/item_stats")
    return refresh_serving(serving_movies(movies, stats), bayesian_top_n(movies, stats, m, n), folder)


def movie_statistics(movies: DataFrame, ratings: DataFrame) -> DataFrame:
    """Rated movies with count and average."""
    return with_stats(movies, item_stats(ratings)).select(
        "movieId", "title", "year", "genres", "rating_count", "avg_rating"
    )


def personalised_recommendations(
    movies: DataFrame, ratings: DataFrame, folder: str, k: int = 10, popular: int = 10, **als
) -> dict[str, DataFrame | ALSModel | float]:
    """Analyse, train, evaluate and recommend for every user; lists and statistics are written as CSV.

    Movies and ratings come from CSV or from cleaned tables; only valid ratings, and of repeated
    pairs the latest, go into training. The lists are exact, and scored as far as factor lengths
    ask (see ``top_items``).
    """
    movies = written(_known_movies(movies), f"{folder}/known_movies")
    ratings = written(ratings.select("userId", "movieId", "rating", "timestamp"), f"{folder}/ratings")
    statistics = written(movie_statistics(movies, ratings), f"{folder}/movie_statistics_table")
    write_csv(statistics, f"{folder}/movie_statistics")
    train, test = train_test_split(written(dedup_latest(valid_ratings(ratings)), f"{folder}/training_ratings"))
    model = als_fit(train, **als)
    lists = written(als_recommend_all(model, k), f"{folder}/lists")
    recommendations = written(recommendations_with_movies(lists, movies), f"{folder}/user_recommendations_table")
    write_csv(recommendations, f"{folder}/user_recommendations")
    best_known = statistics.orderBy(F.desc("rating_count"), "movieId").limit(popular)
    return {
        "distribution": rating_distribution(ratings),
        "active_users": most_active_users(ratings),
        "popular": best_known.select("movieId", "title", "genres", "rating_count", "avg_rating"),
        "best": top_rated_simple(statistics),
        "statistics": statistics,
        "model": model,
        "rmse": als_rmse(model, test),
        "lists": lists,
        "recommendations": recommendations,
    }


def generic_clean_load(
    spark: SparkSession, path: str, jdbc: dict | None = None, mapping: dict[str, str] | None = None
) -> DataFrame:
    """Any CSV, cleaned and mapped to recommendation columns, appended to a table if one is named.

    ``jdbc`` holds ``url``, ``table`` and ``properties``.
    """
    result = map_to_recommendation(clean_any(read_csv(spark, path)), mapping)
    if jdbc:
        write_jdbc(result, jdbc["url"], jdbc["table"], jdbc.get("properties"))
    return result
