"""Whole jobs, run on written inputs."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starboard.operators.cleaning import with_year
from starboard.plans import recommendations as jobs
from starboard.plans import warehouse as wh
from starboard.registry import inputs, query, r6
from starboard.registry.aggregates import VERIFICATION
from starboard.registry.cleaning import CLEAN_ANY
from starboard.registry.ranking import GENRE_TOP
from starboard.registry.scans import fresh_name
from starboard.session import new_folder, prepared
from starboard.sinks.files import write_csv, write_partitioned, write_table_folder
from starboard.sources.files import read_cleaned_movies, read_cleaned_ratings

RAW_STATS = """
(SELECT "movieId", avg(rating) AS avg_rating, count(rating) AS rating_count FROM {ratings} GROUP BY "movieId")
"""
TOP = """
SELECT m."movieId" AS movie_id, round(s.avg_rating, 6) AS popularity_score,
       round((s.rating_count / (s.rating_count + 30.0)) * s.avg_rating
             + (30.0 / (s.rating_count + 30.0)) * p.c, 6) AS recommendation_score
FROM {movies} m JOIN {stats} s ON m."movieId" = s."movieId",
     (SELECT avg(avg_rating) AS c FROM {stats} a) p
WHERE s.rating_count >= 30
ORDER BY (s.rating_count / (s.rating_count + 30.0)) * s.avg_rating
         + (30.0 / (s.rating_count + 30.0)) * p.c DESC, m."movieId"
LIMIT 100
"""
VALID_MOVIES = '(SELECT DISTINCT "movieId", title, year, genres FROM cleaned_movies WHERE is_valid)'


def csv_folder(spark, sf):
    """The raw tables as movies.csv and ratings.csv."""
    folder = new_folder(spark, "upload")
    write_csv(inputs.raw_movies(spark, sf), f"{folder}/movies.csv")
    write_csv(inputs.raw_ratings(spark, sf), f"{folder}/ratings.csv")
    return folder


def warehouse(spark, sf):
    name = fresh_name("warehouse")
    return wh.build_warehouse(
        spark, inputs.raw_movies(spark, sf), inputs.raw_ratings(spark, sf), name, new_folder(spark, name)
    )


def stored_warehouse(spark, sf):
    """A warehouse built once for each session and source."""

    def name(folder):
        return folder.rsplit("/", 1)[-1].replace("-", "_")

    def write(folder):
        wh.build_warehouse(spark, inputs.raw_movies(spark, sf), inputs.raw_ratings(spark, sf), name(folder), folder)

    folder = prepared(spark, "warehouse", sf, write)
    return wh.Warehouse(spark, name(folder), folder)


@query(
    "warehouse_build",
    VERIFICATION
    + """
UNION ALL SELECT 'database', '', 1.0, 'PASS'
UNION ALL SELECT 'table', unnest(['raw_movies', 'raw_ratings', 'cleaned_movies', 'cleaned_ratings', 'data_quality_report']), 1.0, 'PASS'
""",
)
def warehouse_build(spark, sf):
    return warehouse(spark, sf).verification()


@query("warehouse_rebuild", "SELECT * FROM cleaned_ratings")
def warehouse_rebuild(spark, sf):
    """Built from other ratings first, a month of 1990 among them: nothing of it is left."""
    name = fresh_name("warehouse")
    folder = new_folder(spark, name)
    movies, ratings = inputs.raw_movies(spark, sf), inputs.raw_ratings(spark, sf)
    moved = ratings.withColumn("timestamp", F.when(F.col("movieId") % 2 == 0, 640000000).otherwise(F.col("timestamp")))
    wh.build_warehouse(spark, movies, moved, name, folder)
    return wh.build_warehouse(spark, movies, ratings, name, folder).table("cleaned_ratings")


@query(
    "warehouse_months",
    """
SELECT rating_year, rating_month, count(*) AS rating_count, count(DISTINCT "userId") AS unique_users,
       round(avg(rating), 6) AS avg_rating
FROM cleaned_ratings GROUP BY rating_year, rating_month ORDER BY rating_year DESC, rating_month DESC LIMIT 20
""",
)
def warehouse_months(spark, sf):
    return stored_warehouse(spark, sf).ratings_by_month(20).withColumn("avg_rating", r6("avg_rating"))


@query("csv_recommendations", TOP.format(movies="known_movies", stats=RAW_STATS.format(ratings="raw_ratings")))
def csv_recommendations(spark, sf):
    result = jobs.csv_recommendations(
        spark, csv_folder(spark, sf), new_folder(spark, "processed"), m=inputs.M, n=100
    )
    return result["recommendations"].select("movie_id", r6("popularity_score"), r6("recommendation_score"))


def _from_warehouse(spark, sf):
    built = stored_warehouse(spark, sf)
    return wh.warehouse_recommendations(
        spark,
        built.database,
        new_folder(spark, "from_warehouse"),
        m=inputs.M,
        n=100,
        genre_m=inputs.GENRE_M,
        genre_k=10,
    )


@query(
    "warehouse_recommendations",
    TOP.format(movies=VALID_MOVIES, stats=RAW_STATS.format(ratings="cleaned_ratings")),
)
def warehouse_recommendations(spark, sf):
    top = _from_warehouse(spark, sf)["top_movies"]
    return top.select(
        F.col("movieId").alias("movie_id"),
        F.round("avg_rating", 6).alias("popularity_score"),
        F.round("weighted_rating", 6).alias("recommendation_score"),
    )


@query(
    "warehouse_genre_recommendations",
    GENRE_TOP.format(
        movies='(SELECT m.*, s.avg_rating, s.rating_count FROM '
        + VALID_MOVIES
        + " m JOIN "
        + RAW_STATS.format(ratings="cleaned_ratings")
        + ' s ON m."movieId" = s."movieId") v',
        k=10,
    ),
)
def warehouse_genre_recommendations(spark, sf):
    return _from_warehouse(spark, sf)["genre_recommendations"].withColumn("avg_rating", r6("avg_rating"))


PERSONAL = """
SELECT * FROM (SELECT 'popular' AS list, "movieId" AS id, CAST(rating_count AS BIGINT) AS amount
               FROM {movies} m JOIN {stats} s USING ("movieId") ORDER BY rating_count DESC, "movieId" LIMIT 10) p
UNION ALL
SELECT * FROM (SELECT 'active', "userId", count(*) FROM {ratings} GROUP BY "userId"
               ORDER BY count(*) DESC, "userId" NULLS FIRST LIMIT 10) a
UNION ALL
SELECT 'places', "userId", 10 FROM (SELECT DISTINCT "userId" FROM latest_ratings) u
"""


def _personal(movies, ratings, folder):
    """What of the job's results does not depend on the model: popular movies, active users, places on each list."""
    result = jobs.personalised_recommendations(movies, ratings, folder)
    places = result["lists"].groupBy("userId").agg(F.count_distinct("movieId").alias("n"))
    parts = [("popular", result["popular"], "movieId", "rating_count")]
    parts += [("active", result["active_users"], "userId", "rating_count"), ("places", places, "userId", "n")]
    shaped = [
        df.select(F.lit(name).alias("list"), F.col(key).alias("id"), F.col(amount).cast("long").alias("amount"))
        for name, df, key, amount in parts
    ]
    return reduce(DataFrame.unionByName, shaped)


@query(
    "personalised_recommendations",
    PERSONAL.format(movies="known_movies", stats=RAW_STATS.format(ratings="raw_ratings"), ratings="raw_ratings"),
)
def personalised_recommendations(spark, sf):
    movies = with_year(inputs.raw_movies(spark, sf))
    return _personal(movies, inputs.raw_ratings(spark, sf), new_folder(spark, "personalised"))


@query(
    "personalised_from_orc",
    PERSONAL.format(movies=VALID_MOVIES, stats=RAW_STATS.format(ratings="cleaned_ratings"), ratings="cleaned_ratings"),
)
def personalised_from_orc(spark, sf):
    """The same job from the valid rows of cleaned tables in ORC."""
    folder = new_folder(spark, "orc")
    write_table_folder(inputs.cleaned_movies(spark, sf), f"{folder}/movies", format="orc")
    write_partitioned(inputs.cleaned_ratings(spark, sf), f"{folder}/ratings", format="orc", whole_table=True)
    movies = read_cleaned_movies(spark, f"{folder}/movies", "orc")
    ratings = read_cleaned_ratings(spark, f"{folder}/ratings", "orc")
    return _personal(movies, ratings, new_folder(spark, "personalised"))


@query(
    "serving_refresh",
    """
SELECT m."movieId" AS movie_id, m.title, coalesce(m.genres, '') AS genres, m.year,
       round(CAST(CAST(coalesce(s.avg_rating, 0.0) AS FLOAT) AS DOUBLE), 6) AS avg_rating,
       CAST(coalesce(s.rating_count, 0) AS INTEGER) AS rating_count
FROM known_movies m LEFT JOIN {stats} s ON m."movieId" = s."movieId"
""".format(stats=RAW_STATS.format(ratings="raw_ratings")),
)
def serving_refresh(spark, sf):
    movies, _ = jobs.serving_refresh(spark, csv_folder(spark, sf), new_folder(spark, "serving"), m=inputs.M, n=100)
    return movies.withColumn("avg_rating", F.round(F.col("avg_rating").cast("double"), 6))


@query(
    "generic_clean_load",
    CLEAN_ANY.format(
        columns="\"movieId\" AS item_id, trim(coalesce(title, 'Unknown')) AS item_name, "
        "trim(coalesce(genres, 'Unknown')) AS category"
    ),
)
def generic_clean_load(spark, sf):
    mapping = {"item_id": "movieId", "item_name": "title", "category": "genres"}
    return jobs.generic_clean_load(spark, f"{csv_folder(spark, sf)}/movies.csv", mapping=mapping)
