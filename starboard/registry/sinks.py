"""Sinks: each writes, and what was written is the result."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starboard.operators import joins, quality, ranking, serving
from starboard.registry import inputs, query, r6
from starboard.registry.scans import RATINGS_ROWS, fresh_name, written_months
from starboard.session import new_folder
from starboard.sinks import files as sink_files
from starboard.sinks import increments
from starboard.sinks import serving as sink_serving
from starboard.sinks.tables import TABLES, append_table, create_tables, load_cleaned_ratings, overwrite_table
from starboard.sources import catalog, files

TOP_ROWS = """
SELECT s."movieId", s.rating_count,
       round((s.rating_count / (s.rating_count + 30.0)) * s.avg_rating
             + (30.0 / (s.rating_count + 30.0)) * p.mean_rating, 6) AS weighted_rating
FROM movie_statistics s, prior p WHERE s.rating_count >= 30
ORDER BY (s.rating_count / (s.rating_count + 30.0)) * s.avg_rating
         + (30.0 / (s.rating_count + 30.0)) * p.mean_rating DESC, s."movieId"
"""


def top_movies(spark, sf, n):
    return ranking.bayesian_top_n(inputs.known_movies(spark, sf), inputs.item_stats(spark, sf), inputs.M, n)


@query("sink_csv_single", f"{TOP_ROWS} LIMIT 50")
def sink_csv_single(spark, sf):
    folder = new_folder(spark, "top_csv")
    top = top_movies(spark, sf, 50).select("movieId", "rating_count", "weighted_rating")
    sink_files.write_csv(top, folder)
    written = files.read_csv(spark, folder, top.schema)
    return written.withColumn("weighted_rating", r6("weighted_rating"))


@query("sink_csv_user_range", 'SELECT * FROM named_recs WHERE "userId" BETWEEN 100 AND 1000')
def sink_csv_user_range(spark, sf):
    folder = new_folder(spark, "user_range")
    named = joins.recommendations_with_movies(inputs.recommendations(spark, sf), inputs.known_movies(spark, sf))
    sink_files.write_user_range(named, folder, 100, 1000)
    return files.read_user_recommendations(spark, folder)


def _loaded_warehouse(spark, sf):
    database = fresh_name("warehouse")
    folder = new_folder(spark, database)
    movies, ratings = inputs.raw_movies(spark, sf), inputs.raw_ratings(spark, sf)
    sink_files.write_csv(movies, f"{folder}/raw_movies")
    sink_files.write_csv(ratings, f"{folder}/raw_ratings")
    create_tables(spark, database, folder)
    overwrite_table(inputs.cleaned_movies(spark, sf), f"{database}.cleaned_movies")
    load_cleaned_ratings(spark, inputs.cleaned_ratings(spark, sf), database, folder)
    overwrite_table(quality.movie_quality(movies), f"{database}.data_quality_report")
    append_table(quality.rating_quality(ratings), f"{database}.data_quality_report")
    return database


@query(
    "create_tables",
    """
SELECT 'raw_movies' AS table_name, count(*) AS row_number, 3 AS column_number FROM raw_movies
UNION ALL SELECT 'raw_ratings', count(*), 4 FROM raw_ratings
UNION ALL SELECT 'cleaned_movies', count(*), 6 FROM cleaned_movies
UNION ALL SELECT 'cleaned_ratings', count(*), 8 FROM cleaned_ratings
UNION ALL SELECT 'data_quality_report', 2, 7
""",
)
def created_tables(spark, sf):
    database = _loaded_warehouse(spark, sf)
    counted = [
        spark.table(f"{database}.{name}").agg(F.count(F.lit(1)).alias("row_number")).select(
            F.lit(name).alias("table_name"), "row_number", F.lit(len(schema.fields)).alias("column_number")
        )
        for name, schema in TABLES.items()
    ]
    return reduce(DataFrame.unionByName, counted)


@query(
    "catalog_listing",
    """
SELECT 'raw_movies' AS table_name, count(*) > 0 AS filled FROM raw_movies
UNION ALL SELECT 'raw_ratings', count(*) > 0 FROM raw_ratings
UNION ALL SELECT 'cleaned_movies', count(*) > 0 FROM cleaned_movies
UNION ALL SELECT 'cleaned_ratings', count(*) > 0 FROM cleaned_ratings
UNION ALL SELECT 'data_quality_report', count(*) > 0 FROM raw_movies
""",
)
def catalog_listing(spark, sf):
    database = _loaded_warehouse(spark, sf)
    if database not in catalog.databases(spark):
        raise AssertionError(f"{database} is not listed")
    listed = [
        spark.table(f"{database}.{name}").agg((F.count(F.lit(1)) > 0).alias("filled")).select(
            F.lit(name).alias("table_name"), "filled"
        )
        for name in catalog.tables(spark, database)
    ]
    return reduce(DataFrame.unionByName, listed)


@query("overwrite_table", 'SELECT "movieId", title, year, genres, is_valid FROM cleaned_movies')
def overwritten_table(spark, sf):
    """Loaded twice: the second load replaces the first."""
    database = fresh_name("warehouse")
    create_tables(spark, database, new_folder(spark, database))
    for _ in range(2):
        overwrite_table(inputs.cleaned_movies(spark, sf), f"{database}.cleaned_movies")
    return spark.table(f"{database}.cleaned_movies").drop("genres_array")


QUALITY_ROWS = """
SELECT 'raw_movies' AS table_name, 'overall_quality' AS check_type, count(*) AS total_records,
       count(*) FILTER (WHERE NOT good) AS invalid_records, count(*) FILTER (WHERE good) AS valid_records,
       CAST(round(CAST(count(*) FILTER (WHERE NOT good) * 100.0 / count(*) AS DECIMAL(18, 8)), 2) AS DOUBLE)
         AS invalid_percentage
FROM (SELECT coalesce("movieId" IS NOT NULL AND title <> '' AND genres <> '' AND genres <> '(no genres listed)', FALSE)
        AS good FROM raw_movies) m
UNION ALL
SELECT 'raw_ratings', 'overall_quality', count(*),
       count(*) FILTER (WHERE NOT good), count(*) FILTER (WHERE good),
       CAST(round(CAST(count(*) FILTER (WHERE NOT good) * 100.0 / count(*) AS DECIMAL(18, 8)), 2) AS DOUBLE)
FROM (SELECT coalesce("userId" IS NOT NULL AND "movieId" IS NOT NULL AND "timestamp" IS NOT NULL
                      AND rating >= 0.5 AND rating <= 5.0, FALSE) AS good FROM raw_ratings) r
"""


@query("append_table", QUALITY_ROWS)
def appended_table(spark, sf):
    database = fresh_name("warehouse")
    create_tables(spark, database, new_folder(spark, database))
    overwrite_table(quality.movie_quality(inputs.raw_movies(spark, sf)), f"{database}.data_quality_report")
    append_table(quality.rating_quality(inputs.raw_ratings(spark, sf)), f"{database}.data_quality_report")
    return spark.table(f"{database}.data_quality_report").drop("check_timestamp")


@query("dynamic_partition_write", "SELECT * FROM cleaned_ratings")
def dynamic_partition_write(spark, sf):
    """Written twice: each month is replaced, not added to."""
    folder = new_folder(spark, "cleaned_ratings")
    for _ in range(2):
        sink_files.write_partitioned(inputs.cleaned_ratings(spark, sf), folder)
    return spark.read.parquet(folder)


@query("parquet_tuning", f"{RATINGS_ROWS}")
def parquet_tuning(spark, sf):
    folder = written_months(spark, sf, options=sink_files.PARQUET_TUNING)
    return files.read_cleaned_ratings(spark, folder)


@query("export_valid_csv", 'SELECT "movieId", title, year, genres FROM cleaned_movies WHERE is_valid')
def export_valid_csv(spark, sf):
    folder = new_folder(spark, "export")
    columns = ["movieId", "title", "year", "genres"]
    movies = inputs.cleaned_movies(spark, sf).select(*columns, "is_valid")
    sink_files.export_valid_csv(movies, folder, columns)
    return files.read_csv(spark, folder, movies.select(*columns).schema)


@query("export_valid_ratings", 'SELECT "userId", "movieId", rating, "timestamp" FROM cleaned_ratings WHERE is_valid')
def export_valid_ratings(spark, sf):
    folder = new_folder(spark, "export")
    columns = ["userId", "movieId", "rating", "timestamp"]
    ratings = inputs.cleaned_ratings(spark, sf).select(*columns, "is_valid")
    sink_files.export_valid_csv(ratings, folder, columns)
    return files.read_csv(spark, folder, ratings.select(*columns).schema)


MOVIE_FRAME = """
SELECT movie_id, title, {genres} AS genres, year, round(CAST(avg_rating AS DOUBLE), 6) AS avg_rating, rating_count
FROM serving_movies
"""
TOP_FRAME = """
SELECT s."movieId" AS movie_id, round(s.avg_rating, 6) AS popularity_score,
       round((s.rating_count / (s.rating_count + 30.0)) * s.avg_rating
             + (30.0 / (s.rating_count + 30.0)) * p.mean_rating, 6) AS recommendation_score
FROM movie_statistics s, prior p WHERE s.rating_count >= 30
ORDER BY (s.rating_count / (s.rating_count + 30.0)) * s.avg_rating
         + (30.0 / (s.rating_count + 30.0)) * p.mean_rating DESC, s."movieId" LIMIT 100
"""


def _movie_frame(movies):
    return movies.withColumn("avg_rating", F.round(F.col("avg_rating").cast("double"), 6))


def _top_frame(top):
    return top.select("movie_id", r6("popularity_score"), r6("recommendation_score"))


def _frames(spark, sf):
    return serving.prepare_serving_frames(
        inputs.known_movies(spark, sf), inputs.item_stats(spark, sf), top_movies(spark, sf, 100)
    )


@query("prepare_serving_frames", MOVIE_FRAME.format(genres="genres"))
def prepare_serving_frames(spark, sf):
    return _movie_frame(_frames(spark, sf)[0])


@query("prepare_serving_top", TOP_FRAME)
def prepare_serving_top(spark, sf):
    return _top_frame(_frames(spark, sf)[1])


def _refreshed(spark, sf):
    movies = inputs.serving_movies(spark, sf)
    return sink_serving.refresh_serving(movies, top_movies(spark, sf, 100), new_folder(spark, "serving"))


@query("refresh_serving", MOVIE_FRAME.format(genres="coalesce(genres, '')"))
def refresh_serving(spark, sf):
    return _movie_frame(_refreshed(spark, sf)[0])


@query("refresh_serving_top", TOP_FRAME)
def refresh_serving_top(spark, sf):
    return _top_frame(_refreshed(spark, sf)[1])


@query(
    "load_als_serving",
    """
SELECT r."movieId" AS movie_id, r."userId" AS user_id, CAST(r.predicted_rating AS DOUBLE) AS recommendation_score,
       round(s.avg_rating, 6) AS popularity_score
FROM recs r JOIN movie_statistics s ON r."movieId" = s."movieId"
""",
)
def load_als_serving(spark, sf):
    return _als_loaded(spark, sf)[1].withColumn("popularity_score", r6("popularity_score"))


def _als_loaded(spark, sf):
    """Statistics in which each movie stands twice, as a repeated upload has it."""
    rated = joins.with_stats(inputs.known_movies(spark, sf), inputs.item_stats(spark, sf))
    folder = new_folder(spark, "als_serving")
    return sink_serving.load_als_serving(rated.unionByName(rated), inputs.recommendations(spark, sf), folder)


@query(
    "load_als_serving_movies",
    """
SELECT "movieId" AS movie_id, title, coalesce(genres, '') AS genres, year, round(avg_rating, 6) AS avg_rating,
       CAST(rating_count AS INTEGER) AS rating_count
FROM movie_statistics
""",
)
def load_als_serving_movies(spark, sf):
    return _als_loaded(spark, sf)[0].withColumn("avg_rating", r6("avg_rating"))


@query(
    "load_als_serving_skipped",
    'SELECT count(*) AS skipped FROM recs WHERE "movieId" NOT IN (SELECT "movieId" FROM movie_statistics)',
)
def load_als_serving_skipped(spark, sf):
    return _als_loaded(spark, sf)[2]


# Three increments: all ratings; a seventh of the pairs rated anew forty days later; an eleventh as they were forty days before.
MOVED = """
SELECT "userId", "movieId", rating, "timestamp" FROM valid_ratings
UNION ALL SELECT "userId", "movieId", 5.5 - rating, "timestamp" + 3456000 FROM valid_ratings WHERE ("userId" + "movieId") % 7 = 0
UNION ALL SELECT "userId", "movieId", 5.5 - rating, "timestamp" - 3456000 FROM valid_ratings WHERE ("userId" + "movieId") % 11 = 0
"""
LATEST_MOVED = f"""
SELECT "userId", "movieId", rating, "timestamp" FROM (
  SELECT *, row_number() OVER (PARTITION BY "userId", "movieId" ORDER BY "timestamp" DESC, rating DESC) AS rn FROM ({MOVED}) m) t
WHERE rn = 1
"""


def _increments(spark, sf):
    raw = inputs.raw_ratings(spark, sf)
    turned = (5.5 - F.col("rating")).alias("rating")

    def moved(every, seconds):
        some = inputs.valid_ratings(spark, sf).where((F.col("userId") + F.col("movieId")) % every == 0)
        return some.select("userId", "movieId", turned, (F.col("timestamp") + seconds).alias("timestamp"))

    return [raw, moved(7, 3_456_000), moved(11, -3_456_000)]


@query(
    "upsert_increments",
    f"""
SELECT "userId", "movieId", rating, strftime(make_timestamp("timestamp" * 1000000), '%Y-%m-%d %H:%M:%S') AS rating_date,
       "timestamp", TRUE AS is_valid, CAST(year(make_timestamp("timestamp" * 1000000)) AS INTEGER) AS rating_year,
       CAST(month(make_timestamp("timestamp" * 1000000)) AS INTEGER) AS rating_month
FROM ({LATEST_MOVED}) t
""",
)
def upsert_increments(spark, sf):
    """Pairs move to later months and lose to later ratings; the table is that of all increments together."""
    folder = new_folder(spark, "increments")
    increments.upsert_all(spark, folder, _increments(spark, sf))
    return increments.read_increments(spark, folder)


@query(
    "incremental_item_stats",
    f"""
SELECT "movieId", round(avg(rating), 6) AS avg_rating, count(*) AS rating_count FROM ({LATEST_MOVED}) t GROUP BY "movieId"
""",
)
def incremental_item_stats(spark, sf):
    """From sums that each increment changes; the ratings themselves are not read."""
    folder = new_folder(spark, "increments")
    increments.upsert_all(spark, folder, _increments(spark, sf))
    return increments.current_item_stats(spark, folder).select("movieId", r6("avg_rating"), "rating_count")
