"""Ratings-like tables, with dirt in known places, derived from the given star schema.

Movies come from ``part``, ratings from ``lineitem`` joined to ``orders``. Every row of
those tables is used; the remainders only choose which rows are made dirty.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starboard.functions.time import utc_seconds
from starboard.operators.cleaning import dedup_latest, valid_ratings
from starboard.schemas import NO_GENRES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_movies(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    word = lambda n: F.split_part("p_name", F.lit(" "), F.lit(n))
    title = (
        F.when(key % 83 == 0, "")
        .when(key % 97 == 0, F.col("p_name"))
        .otherwise(
            F.concat(
                "p_name",
                F.when(key % 5 == 0, ", The").otherwise(""),
                F.lit(" ("),
                (1950 + key % 70).cast("string"),
                F.lit(")"),
                F.when(key % 73 == 0, " ").otherwise(""),
            )
        )
    )
    genres = (
        F.when(key % 79 == 0, None)
        .when(key % 89 == 0, NO_GENRES)
        .when(F.col("p_size") % 3 == 0, F.col("p_type"))
        .when(F.col("p_size") % 3 == 1, F.concat_ws("|", "p_type", word(1)))
        .otherwise(F.concat_ws("|", "p_type", word(1), word(2)))
    )
    copies = F.array_repeat(F.lit(1), F.when(key % 71 == 0, 2).otherwise(1))
    return table(spark, sf_dir, "part").select(
        F.when(key % 199 != 0, key.cast("int")).alias("movieId"),
        title.alias("title"),
        genres.alias("genres"),
        F.explode(copies).alias("copy"),
    ).drop("copy")


def raw_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    h = F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13 + F.col("l_partkey")
    item = F.when(h % 113 == 0, F.col("l_partkey") + 1000000).otherwise(F.col("l_partkey"))
    rating = (
        F.when(h % 107 == 0, None)
        .when(h % 101 == 0, 0.0)
        .when(h % 103 == 0, 5.5)
        .otherwise(F.ceil(F.col("l_quantity") / 5) / 2)
    )
    return lines.select(
        F.when(h % 109 != 0, F.col("o_custkey").cast("int")).alias("userId"),
        item.cast("int").alias("movieId"),
        rating.cast("double").alias("rating"),
        F.when(h % 127 != 0, utc_seconds(F.col("l_shipdate"))).alias("timestamp"),
    )


def loose_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings of which those without a user are empty rows, so that there are whole empty and whole repeated rows."""
    raw = raw_ratings(spark, sf_dir)
    return raw.select(*(F.when(F.col("userId").isNotNull(), F.col(c)).alias(c) for c in raw.columns))


def recommendation_lists(spark: SparkSession, sf_dir: str, k: int = 10, raw: DataFrame | None = None) -> DataFrame:
    """Each user's k best-rated items as array<struct<movieId:int, rating:float>>.

    The same shape as a fitted model's lists, but with values that do not depend on
    training, so that the operators on such lists can be compared exactly. ``raw`` are the raw
    ratings where they are stored already.
    """
    best = Window.partitionBy("userId").orderBy(F.desc("rating"), "movieId")
    # Dealt by user, as pairs and lists of a user are both within the user's rows.
    known = valid_ratings(raw_ratings(spark, sf_dir) if raw is None else raw)
    ratings = dedup_latest(known.repartition("userId"))
    return (
        ratings.withColumn("position", F.row_number().over(best))
        .where(F.col("position") <= k)
        .groupBy("userId")
        .agg(F.sort_array(F.collect_list(F.struct("position", "movieId", F.col("rating").cast("float").alias("rating")))).alias("r"))
        .select("userId", F.transform("r", lambda x: F.struct(x["movieId"].alias("movieId"), x["rating"].alias("rating"))).alias("recommendations"))
    )


def raw_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploaded files: one for each supplier, done when its balance is positive."""
    return table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("data_file"),
        (F.col("s_acctbal") > 0).alias("processed"),
        F.col("s_suppkey").cast("int").alias("record_count"),
    )
