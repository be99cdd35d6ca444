"""Sources: the derived tables are written in each format and read back."""

import uuid

from pyspark.sql import functions as F

from starboard.operators import cleaning, joins
from starboard.registry import inputs, query, r6
from starboard.schemas import CLEANED_RATINGS
from starboard.session import new_folder
from starboard.sinks import files as sink_files
from starboard.sinks.tables import create_tables, overwrite_table
from starboard.sources import catalog, files

RATINGS_ROWS = 'SELECT "userId", "movieId", rating, rating_date, "timestamp" FROM dated_ratings'


def fresh_name(prefix):
    return f"{prefix}_{uuid.uuid4().hex}"


def written_months(spark, sf, format="parquet", options=None):
    """Cleaned ratings, repeated pairs included, in folders by year and month."""
    folder = new_folder(spark, "ratings_by_month")
    ratings = cleaning.clean_ratings(inputs.raw_ratings(spark, sf), dedup=False)
    sink_files.write_partitioned(ratings, folder, format=format, options=options)
    return folder


@query("scan_movies_csv", 'SELECT "movieId", title, genres, year FROM movies_with_year')
def scan_movies_csv(spark, sf):
    folder = new_folder(spark, "movies_csv")
    sink_files.write_csv(inputs.raw_movies(spark, sf), folder)
    return files.read_movies(spark, folder)


@query("scan_ratings_csv", 'SELECT "userId", "movieId", rating, "timestamp" FROM raw_ratings')
def scan_ratings_csv(spark, sf):
    folder = new_folder(spark, "ratings_csv")
    sink_files.write_csv(inputs.raw_ratings(spark, sf), folder)
    return files.read_ratings(spark, folder)


@query("scan_csv_inferred", 'SELECT "userId", "movieId", rating, "timestamp" FROM raw_ratings')
def scan_csv_inferred(spark, sf):
    folder = new_folder(spark, "inferred_csv")
    sink_files.write_csv(inputs.raw_ratings(spark, sf), folder)
    return files.read_csv(spark, folder).withColumn("timestamp", F.col("timestamp").cast("long"))


@query("external_text_table", 'SELECT "movieId", title, genres FROM raw_movies')
def external_text_table(spark, sf):
    folder = new_folder(spark, "text_table")
    sink_files.write_csv(inputs.raw_movies(spark, sf), folder)
    name = fresh_name("raw_movies")
    return catalog.register_text_table(spark, name, "movieId INT, title STRING, genres STRING", folder)


@query("scan_table_valid", 'SELECT "movieId", title, year, genres FROM cleaned_movies WHERE is_valid')
def scan_table_valid(spark, sf):
    database = fresh_name("warehouse")
    create_tables(spark, database, new_folder(spark, database))
    overwrite_table(inputs.cleaned_movies(spark, sf), f"{database}.cleaned_movies")
    return catalog.valid_table(spark, f"{database}.cleaned_movies", ["movieId", "title", "year", "genres"])


@query("scan_parquet_path", 'SELECT "movieId", title, year, genres FROM cleaned_movies WHERE is_valid')
def scan_parquet_path(spark, sf):
    folder = new_folder(spark, "cleaned_movies")
    sink_files.write_table_folder(inputs.cleaned_movies(spark, sf), folder)
    return files.read_cleaned_movies(spark, folder)


@query("scan_orc_path", RATINGS_ROWS)
def scan_orc_path(spark, sf):
    return files.read_cleaned_ratings(spark, written_months(spark, sf, "orc"), "orc")


@query("partition_scan", f"{RATINGS_ROWS} WHERE rating_year = 1998 AND rating_month = 1")
def partition_scan(spark, sf):
    month = files.read_month(spark, written_months(spark, sf), 1998, 1)
    return month.select("userId", "movieId", "rating", "rating_date", "timestamp")


@query(
    "temp_views_sql",
    """
SELECT "movieId", title, year, CAST(sum(n) AS BIGINT) AS rating_count, round(sum(total) / sum(n), 6) AS avg_rating
FROM (SELECT * FROM cleaned_movies WHERE is_valid) m
JOIN (SELECT "movieId", count(rating) AS n, sum(rating) AS total FROM dated_ratings WHERE is_valid GROUP BY "movieId") rated USING ("movieId")
GROUP BY ALL HAVING sum(n) >= 30 ORDER BY sum(total) / sum(n) DESC, "movieId" LIMIT 10
""",
)
def temp_views_sql(spark, sf):
    """SQL over views; the ratings are reduced to items before they meet the movies."""
    ratings = cleaning.clean_ratings(inputs.raw_ratings(spark, sf), dedup=False)
    views = {"starboard_movies": inputs.cleaned_movies(spark, sf), "starboard_ratings": ratings}
    top = catalog.query_views(
        spark,
        views,
        f"""
        WITH rated AS (
          SELECT movieId, count(rating) AS n, sum(rating) AS total FROM starboard_ratings WHERE is_valid
          GROUP BY movieId
        ),
        named AS (
          SELECT movieId, title, year, count(*) AS copies FROM starboard_movies WHERE is_valid
          GROUP BY movieId, title, year
        )
        SELECT movieId, title, year, n * copies AS rating_count, total / n AS avg_rating
        FROM named JOIN rated USING (movieId)
        WHERE n * copies >= {inputs.M}
        ORDER BY avg_rating DESC, movieId LIMIT 10
        """,
    )
    return top.withColumn("avg_rating", r6("avg_rating"))


@query("strip_qualifier", 'SELECT "movieId", title, genres FROM raw_movies')
def strip_qualifier(spark, sf):
    movies = inputs.raw_movies(spark, sf)
    return catalog.strip_qualifier(movies.toDF(*[f"raw_movies.{c}" for c in movies.columns]))


@query("scan_recs_csv", "SELECT * FROM named_recs")
def scan_recs_csv(spark, sf):
    folder = new_folder(spark, "user_recommendations")
    named = joins.recommendations_with_movies(inputs.recommendations(spark, sf), inputs.known_movies(spark, sf))
    sink_files.write_csv(named, folder)
    return files.read_user_recommendations(spark, folder)


@query(
    "scan_statistics_csv",
    'SELECT "movieId", title, year, genres, rating_count, round(avg_rating, 6) AS avg_rating FROM movie_statistics',
)
def scan_statistics_csv(spark, sf):
    folder = new_folder(spark, "movie_statistics")
    rated = joins.with_stats(inputs.known_movies(spark, sf), inputs.item_stats(spark, sf))
    columns = ["movieId", "title", "year", "genres", "rating_count", "avg_rating"]
    sink_files.write_csv(rated.select(*columns), folder)
    return files.read_movie_statistics(spark, folder).withColumn("avg_rating", r6("avg_rating"))


@query(
    "partition_listing",
    """
SELECT DISTINCT concat('rating_year=', rating_year, '/rating_month=', rating_month) AS partition FROM dated_ratings
""",
)
def partition_listing(spark, sf):
    table = _month_table(spark, written_months(spark, sf))
    catalog.repair_partitions(spark, table)
    return catalog.partitions(spark, table)


@query(
    "repair_partitions",
    """
SELECT rating_year, rating_month, count(*) AS rating_count, sum(rating) AS total
FROM dated_ratings GROUP BY rating_year, rating_month
""",
)
def repair_partitions(spark, sf):
    table = _month_table(spark, written_months(spark, sf))
    if catalog.partitions(spark, table).limit(1).count():
        raise AssertionError("the catalogue must not know the partitions yet")
    catalog.repair_partitions(spark, table)
    months = spark.table(table).groupBy("rating_year", "rating_month")
    return months.agg(F.count(F.lit(1)).alias("rating_count"), F.sum("rating").alias("total"))


def _month_table(spark, folder):
    table = fresh_name("cleaned_ratings")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in CLEANED_RATINGS.fields)
    spark.sql(
        f"CREATE TABLE {table} ({columns}) USING parquet PARTITIONED BY (rating_year, rating_month) LOCATION '{folder}'"
    )
    return table


@query(
    "sample_rows",
    """
SELECT "movieId", title, year, genres FROM cleaned_movies WHERE is_valid ORDER BY "movieId", title LIMIT 5
""",
)
def sample_rows(spark, sf):
    valid = inputs.cleaned_movies(spark, sf).where(F.col("is_valid"))
    return files.sample_rows(valid.select("movieId", "title", "year", "genres"), ["movieId", "title"], 5)
