"""Training, evaluation and recommendation. What is compared does not depend on the model's numbers."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from starboard.operators import recommend
from starboard.operators.stats import most_active_users
from starboard.registry import inputs, query

# As many as the ratings need (see ``als_fit``), two for the given tables; the same number gives the same model.
BLOCKS = None


@query(
    "train_test_split",
    """
SELECT "userId", count(*) AS ratings, sum(rating) AS total, CAST(0 AS BIGINT) AS pairs_on_both_sides
FROM valid_ratings GROUP BY "userId"
""",
)
def train_test_split(spark, sf):
    """Both sides together are the input, and no pair is on both. One scan, with the side as a column."""
    sides = inputs.valid_ratings(spark, sf).withColumn("side", recommend.in_training().cast("int"))
    pairs = sides.groupBy("userId", "movieId").agg(
        F.count(F.lit(1)).alias("n"), F.sum("rating").alias("total"), (F.max("side") - F.min("side")).alias("both")
    )
    return pairs.groupBy("userId").agg(
        F.sum("n").alias("ratings"), F.sum("total").alias("total"), F.sum("both").cast("long").alias("pairs_on_both_sides")
    )


@query("als_fit", 'SELECT DISTINCT "movieId", 10 AS factors FROM latest_ratings')
def als_fit(spark, sf):
    """Every rated item has its factors."""
    model = recommend.als_fit(inputs.stored_cleaned(spark, sf)[1], blocks=BLOCKS)
    return model.itemFactors.select(F.col("id").alias("movieId"), F.size("features").alias("factors"))


@query("als_rmse", "SELECT count(*) AS rows, TRUE AS better_than_mean FROM latest_ratings")
def als_rmse(spark, sf):
    """On the rows of the training, all of which are predicted: closer than their mean."""
    ratings = inputs.stored_cleaned(spark, sf)[1]
    error = recommend.prediction_error(recommend.als_fit(ratings, blocks=BLOCKS), ratings)
    spread = ratings.agg(F.stddev_pop("rating")).scalar()
    return error.select("rows", (F.col("rmse") < spread).alias("better_than_mean"))


@query(
    "als_heldout_error",
    """
SELECT CAST(count_if(known) AS BIGINT) AS predicted, CAST(count_if(NOT known) AS BIGINT) AS cold, TRUE AS above_training_error
FROM (SELECT t."userId" IN (SELECT "userId" FROM latest_ratings WHERE ("userId" * 31 + "movieId") % 5 <> 0)
             AND t."movieId" IN (SELECT "movieId" FROM latest_ratings WHERE ("userId" * 31 + "movieId") % 5 <> 0) AS known
      FROM latest_ratings t WHERE ("userId" * 31 + "movieId") % 5 = 0) s
""",
)
def als_heldout_error(spark, sf):
    """Trained on four fifths, judged on the rest: rows predicted, rows dropped as cold, and that the error is the larger one."""
    ratings = inputs.stored_cleaned(spark, sf)[1]
    held_out = (F.col("userId").cast("long") * 31 + F.col("movieId")) % 5 == 0
    train, test = ratings.where(~held_out), ratings.where(held_out)
    model = recommend.als_fit(train, blocks=BLOCKS)
    error = recommend.prediction_error(model, test).withColumnRenamed("rows", "predicted")
    own = recommend.prediction_error(model, train).select("rmse").scalar()
    cold = test.agg(F.count(F.lit(1))).scalar() - F.col("predicted")
    return error.select("predicted", cold.alias("cold"), (F.col("rmse") > own).alias("above_training_error"))


@query(
    "top_items_exact",
    """
SELECT "userId", "movieId", rating FROM (
  SELECT u."userId", i."movieId", CAST(u.a * i.a + u.b * i.b + u.c * i.c AS FLOAT) AS rating,
         row_number() OVER (PARTITION BY u."userId" ORDER BY u.a * i.a + u.b * i.b + u.c * i.c DESC, i."movieId") AS place
  FROM (SELECT c_custkey AS "userId", c_custkey % 7 - 2 AS a, c_custkey % 11 - 3 AS b, c_nationkey % 5 AS c FROM customer) u
  CROSS JOIN (SELECT p_partkey AS "movieId", (p_partkey % 13 - 4) * (p_size % 9) AS a, (p_partkey % 5 - 1) * (p_size % 9) AS b,
                     p_size % 4 AS c FROM part) i) t
WHERE place <= 10
""",
)
def top_items_exact(spark, sf):
    """Factors that are whole numbers, so that products are exact and many are equal."""
    def factors(table, key, *columns):
        values = F.array(*(F.expr(f"CAST({c} AS FLOAT)") for c in columns))
        return spark.read.parquet(f"{sf}/{table}.parquet").select(F.col(key).alias("id"), values.alias("features"))

    users = factors("customer", "c_custkey", "c_custkey % 7 - 2", "c_custkey % 11 - 3", "c_nationkey % 5")
    items = factors("part", "p_partkey", "(p_partkey % 13 - 4) * (p_size % 9)", "(p_partkey % 5 - 1) * (p_size % 9)", "p_size % 4")
    lists = recommend.top_items(users, items, 10)
    return lists.select(F.col("id").alias("userId"), F.inline("recommendations"))


def _places(lists):
    best = Window.partitionBy("userId").orderBy(F.desc("predicted_rating"), "movieId")
    return lists.select("userId", F.row_number().over(best).alias("place"))


@query("als_recommend_all", 'SELECT DISTINCT "userId", unnest(range(1, 11))::INTEGER AS place FROM latest_ratings')
def als_recommend_all(spark, sf):
    """Every user has a list of ten places."""
    model = recommend.als_fit(inputs.stored_cleaned(spark, sf)[1], blocks=BLOCKS)
    return _places(recommend.als_recommend_all(model, 10))


@query(
    "als_recommend_users",
    """
SELECT "userId", unnest(range(1, 11))::INTEGER AS place FROM (
  SELECT "userId" FROM latest_ratings GROUP BY "userId" ORDER BY count(*) DESC, "userId" LIMIT 25) u
""",
)
def als_recommend_users(spark, sf):
    """The 25 most active users only: the work follows their number."""
    ratings = inputs.stored_cleaned(spark, sf)[1]
    users = most_active_users(ratings, 25).select("userId")
    return _places(recommend.als_recommend_users(recommend.als_fit(ratings, blocks=BLOCKS), users, 10))


@query(
    "als_recommend_shape",
    """
SELECT DISTINCT "userId", CAST(10 AS BIGINT) AS items, CAST(0 AS BIGINT) AS unknown_items FROM valid_ratings
""",
)
def als_recommend_shape(spark, sf):
    """Every user gets ten different items, all of them rated by someone."""
    ratings = inputs.stored_cleaned(spark, sf)[1]
    lists = recommend.als_recommend_all(recommend.als_fit(ratings, blocks=BLOCKS), 10)
    rated = ratings.select("movieId").distinct().withColumn("known", F.lit(1))
    return (
        lists.join(rated, "movieId", "left")
        .groupBy("userId")
        .agg(F.count_distinct("movieId").alias("items"), F.count_if(F.col("known").isNull()).alias("unknown_items"))
    )
