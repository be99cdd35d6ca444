"""What is known of each month, stored so that months add up: sums, and the users and items as bitmaps.

Distinct users of several months are no sum of theirs. As bitmaps they are an OR: exact, without the ratings, and without a
shuffle of distinct values. Ids should be numbered closely, as a bitmap of 4 KB holds 32,768 neighbouring ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starboard.schemas import RATING_PARTITIONS
from starboard.sinks.files import write_partitioned

KINDS = {"user": "userId", "item": "movieId"}


def month_sums(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy(*RATING_PARTITIONS).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("is_valid")).alias("valid"),
        F.count("rating").alias("rated"),
        F.sum("rating").alias("total"),
        F.min("rating").alias("low"),
        F.max("rating").alias("high"),
    )


def month_bitmaps(ratings: DataFrame, kind: str) -> DataFrame:
    """``bucket`` and ``bitmap`` of the month's users or items.

    A bitmap of 4 KB for each task and bucket would be far more than the numbers in it, so it is the month's numbers that
    are brought together.
    """
    number = F.col(KINDS[kind]).cast("long")
    numbers = ratings.where(number.isNotNull()).select(*RATING_PARTITIONS, number.alias("number"))
    placed = numbers.withColumn("bucket", F.bitmap_bucket_number("number")).repartition(*RATING_PARTITIONS, "bucket")
    bits = placed.groupBy(*RATING_PARTITIONS, "bucket")
    return bits.agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bitmap"))


def write_month_state(ratings: DataFrame, folder: str, whole_table: bool = False) -> None:
    """Write the state of the months in ``ratings``; with ``whole_table`` no others stay.

    After an increment give it the whole rows of the months that were touched.
    """
    write_partitioned(month_sums(ratings), f"{folder}/sums", whole_table=whole_table)
    for kind in KINDS:
        write_partitioned(month_bitmaps(ratings, kind), f"{folder}/{kind}", whole_table=whole_table)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}")


def distinct_in_months(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """Distinct users or items of each month."""
    bits = F.sum(F.bitmap_count("bitmap")).alias(f"unique_{kind}s")
    return _table(spark, folder, kind).groupBy(*RATING_PARTITIONS).agg(bits)


def distinct_in_all(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """One row: distinct users or items of all months together."""
    merged = _table(spark, folder, kind).groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    return merged.agg(F.coalesce(F.sum(F.bitmap_count("bitmap")), F.lit(0)).alias(f"unique_{kind}s"))


def stored_ratings_by_month(spark: SparkSession, folder: str, n: int = 20) -> DataFrame:
    """As ``ratings_by_month``: the latest n months, with their distinct users."""
    latest = _table(spark, folder, "sums").orderBy(*(F.desc(c) for c in RATING_PARTITIONS)).limit(n)
    found = latest.join(distinct_in_months(spark, folder, "user"), RATING_PARTITIONS, "left")
    return found.select(
        *RATING_PARTITIONS,
        F.col("n").alias("rating_count"),
        F.coalesce("unique_users", F.lit(0)).alias("unique_users"),
        F.try_divide("total", "rated").alias("avg_rating"),
    ).orderBy(*(F.desc(c) for c in RATING_PARTITIONS))


def stored_totals(spark: SparkSession, folder: str) -> DataFrame:
    """As ``verify_ratings``, from the state of all months."""
    zero = F.lit(0)
    sums = _table(spark, folder, "sums").agg(
        F.coalesce(F.sum("n"), zero).alias("total_records"),
        F.coalesce(F.sum("valid"), zero).alias("valid_records"),
        F.coalesce(F.sum(F.col("n") - F.col("valid")), zero).alias("invalid_records"),
        F.min("low").alias("min_rating"),
        F.max("high").alias("max_rating"),
        F.try_divide(F.sum("total"), F.sum("rated")).alias("avg_rating"),
    )
    return sums.select(
        F.lit("cleaned_ratings").alias("table_name"),
        "total_records",
        "valid_records",
        "invalid_records",
        distinct_in_all(spark, folder, "user").scalar().alias("unique_users"),
        distinct_in_all(spark, folder, "item").scalar().alias("unique_movies"),
        "min_rating",
        "max_rating",
        "avg_rating",
    )
