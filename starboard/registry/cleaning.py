"""Cleaning of ratings data and of any table."""

from pyspark.sql import functions as F

from starboard import fixtures
from starboard.operators import cleaning, generic
from starboard.registry import inputs, query


@query("drop_duplicates", 'SELECT DISTINCT "movieId", title, genres FROM raw_movies')
def drop_duplicates(spark, sf):
    return generic.drop_duplicate_rows(inputs.raw_movies(spark, sf))


@query("drop_all_null", 'SELECT * FROM loose_ratings WHERE coalesce("userId", "movieId", rating, "timestamp") IS NOT NULL')
def drop_all_null(spark, sf):
    return generic.drop_all_null(fixtures.loose_ratings(spark, sf))


@query(
    "fill_unknown",
    """
SELECT "movieId", coalesce(title, 'Unknown') AS title, coalesce(genres, 'Unknown') AS genres FROM raw_movies
""",
)
def fill_unknown(spark, sf):
    return generic.fill_unknown(inputs.raw_movies(spark, sf))


@query("trim_strings", 'SELECT "movieId", trim(title) AS title, trim(genres) AS genres FROM raw_movies')
def trim_strings(spark, sf):
    return generic.trim_strings(inputs.raw_movies(spark, sf))


CLEAN_ANY = """
SELECT {columns}
FROM (SELECT DISTINCT "movieId", title, genres FROM raw_movies) d
WHERE "movieId" IS NOT NULL OR title IS NOT NULL OR genres IS NOT NULL
"""


@query(
    "clean_any",
    CLEAN_ANY.format(
        columns="\"movieId\", trim(coalesce(title, 'Unknown')) AS title, trim(coalesce(genres, 'Unknown')) AS genres"
    ),
)
def clean_any(spark, sf):
    return generic.clean_any(inputs.raw_movies(spark, sf))


@query(
    "clean_counts",
    """
SELECT (SELECT count(*) FROM loose_ratings) AS input_rows,
       (SELECT count(*) FROM loose_ratings) - count(*) AS duplicates_removed,
       count(*) - count(coalesce("userId", "movieId", rating, "timestamp")) AS empty_rows_removed,
       count(coalesce("userId", "movieId", rating, "timestamp")) AS output_rows,
       4 AS column_number
FROM (SELECT DISTINCT * FROM loose_ratings) d
""",
)
def clean_counts(spark, sf):
    return generic.clean_counts(fixtures.loose_ratings(spark, sf))


@query(
    "map_to_recommendation",
    'SELECT "movieId" AS item_id, title AS item_name, genres AS category FROM known_movies',
)
def map_to_recommendation(spark, sf):
    mapping = {"item_id": "movieId", "item_name": "title", "category": "genres"}
    return generic.map_to_recommendation(inputs.known_movies(spark, sf), mapping)


@query("dedup_latest", "SELECT * FROM latest_ratings")
def dedup_latest(spark, sf):
    return cleaning.dedup_latest(inputs.valid_ratings(spark, sf))


@query(
    "clean_movies",
    """
SELECT "movieId", title, year, genres, is_valid, CAST(len(genres_array) AS INTEGER) AS genre_number,
       array_to_string(genres_array, ' / ') AS genre_list
FROM cleaned_movies
""",
)
def clean_movies(spark, sf):
    movies = cleaning.clean_movies(inputs.raw_movies(spark, sf))
    return movies.withColumns(
        {"genre_number": F.size("genres_array"), "genre_list": F.array_join("genres_array", " / ")}
    ).drop("genres_array")


@query("clean_ratings", "SELECT * FROM cleaned_ratings")
def clean_ratings(spark, sf):
    return cleaning.clean_ratings(inputs.raw_ratings(spark, sf))


@query("clean_ratings_nodedup", "SELECT * FROM dated_ratings")
def clean_ratings_nodedup(spark, sf):
    return cleaning.clean_ratings(inputs.raw_ratings(spark, sf), dedup=False)
