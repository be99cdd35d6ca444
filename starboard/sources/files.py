"""CSV, Parquet and ORC.

CSV is read with quoting, so a title with a comma in it stays one field. Schemas are fixed
by default: inference reads the whole text once more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from starboard.operators.cleaning import with_year
from starboard.schemas import CSV_READ, MOVIE_STATISTICS, RAW_MOVIES, RAW_RATINGS, USER_RECOMMENDATIONS


def read_csv(spark: SparkSession, path: str, schema: StructType | None = None, header: bool = True) -> DataFrame:
    """CSV with a schema, or with an inferred one; a missing file raises."""
    reader = spark.read.option("header", header).options(**CSV_READ)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_movies(spark: SparkSession, path: str) -> DataFrame:
    return with_year(read_csv(spark, path, RAW_MOVIES))


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, RAW_RATINGS)


def read_movie_statistics(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, MOVIE_STATISTICS)


def read_user_recommendations(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, USER_RECOMMENDATIONS)


def read_cleaned_movies(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """Valid movies, without the genre array."""
    movies = spark.read.format(format).load(path)
    return movies.where(F.col("is_valid")).select("movieId", "title", "year", "genres")


def read_cleaned_ratings(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """Valid ratings from a directory partitioned by year and month."""
    ratings = spark.read.format(format).load(path)
    return ratings.where(F.col("is_valid")).select("userId", "movieId", "rating", "rating_date", "timestamp")


def read_month(spark: SparkSession, path: str, year: int, month: int, format: str = "parquet") -> DataFrame:
    """One month of the cleaned ratings; only that partition's files are opened."""
    ratings = spark.read.format(format).load(path)
    return ratings.where((F.col("rating_year") == year) & (F.col("rating_month") == month))


def sample_rows(df: DataFrame, order: list, n: int = 5) -> DataFrame:
    """The first n rows in the given order, so that a sample is the same each time."""
    return df.orderBy(*order).limit(n)
