"""Windows, top-k lists and generators."""

from pyspark.sql import functions as F

from starboard.operators import cleaning, joins, ranking
from starboard.operators.recommend import explode_recommendations
from starboard.registry import inputs, query, r6

TOP_HAVING = """
SELECT "movieId", title, year, genres, CAST(sum(n) AS BIGINT) AS rating_count, round(sum(total) / sum(n), 6) AS avg_rating
FROM (SELECT "movieId", count(rating) AS n, sum(rating) AS total FROM {ratings} WHERE is_valid GROUP BY "movieId") rated
JOIN (SELECT * FROM cleaned_movies WHERE is_valid) m USING ("movieId")
GROUP BY ALL {having}
{tail}
"""

GENRE_TOP = """
SELECT * FROM (
  SELECT "movieId", title, genre, year, round(avg_rating, 6) AS avg_rating, rating_count,
         CAST(row_number() OVER (PARTITION BY genre ORDER BY avg_rating DESC, rating_count DESC, "movieId") AS INTEGER)
           AS rank
  FROM (SELECT *, unnest(string_split(genres, '|')) AS genre FROM {movies}) g
  WHERE rating_count >= 20) t
WHERE rank <= {k}
"""


@query("genre_top_k", GENRE_TOP.format(movies="movie_statistics", k=10))
def genre_top_k(spark, sf):
    best = ranking.genre_top_k(inputs.known_movies(spark, sf), inputs.item_stats(spark, sf), inputs.GENRE_M, 10)
    return best.withColumn("avg_rating", r6("avg_rating"))


@query(
    "year_top_k",
    """
SELECT "userId", "movieId", rating, rating_year, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY rating_year ORDER BY rating DESC, "timestamp" DESC, "userId", "movieId")
                 AS INTEGER) AS rank
  FROM cleaned_ratings) t
WHERE rank <= 1500
""",
)
def year_top_k(spark, sf):
    """More of each group than Spark's group limit takes: ranked in slices first."""
    order = [F.desc("rating"), F.desc("timestamp"), "userId", "movieId"]
    best = ranking.top_k_per_group(inputs.stored_cleaned(spark, sf)[1], "rating_year", order, 1500, "userId")
    return best.select("userId", "movieId", "rating", "rating_year", "rank")


@query(
    "genre_count",
    "SELECT count(DISTINCT genre) AS genre_count FROM (" + GENRE_TOP.format(movies="movie_statistics", k=10) + ") b",
)
def genre_count(spark, sf):
    best = ranking.genre_top_k(inputs.known_movies(spark, sf), inputs.item_stats(spark, sf), inputs.GENRE_M, 10)
    return ranking.genre_count(best)


@query(
    "bayesian_top_n",
    """
SELECT s."movieId", s.title, s.genres, s.year, round(s.avg_rating, 6) AS avg_rating, s.rating_count,
       round((s.rating_count / (s.rating_count + 30.0)) * s.avg_rating
             + (30.0 / (s.rating_count + 30.0)) * p.mean_rating, 6) AS weighted_rating
FROM movie_statistics s, prior p WHERE s.rating_count >= 30
ORDER BY (s.rating_count / (s.rating_count + 30.0)) * s.avg_rating
         + (30.0 / (s.rating_count + 30.0)) * p.mean_rating DESC, s."movieId"
LIMIT 100
""",
)
def bayesian_top_n(spark, sf):
    top = ranking.bayesian_top_n(inputs.known_movies(spark, sf), inputs.item_stats(spark, sf), inputs.M, 100)
    return top.withColumns({"avg_rating": r6("avg_rating"), "weighted_rating": r6("weighted_rating")})


@query(
    "log_blend_top_n",
    """
SELECT "movieId", title, rating_count, round(avg_rating * 0.7 + ln(rating_count + 1) * 0.3, 6) AS recommendation_score
FROM movie_statistics
ORDER BY avg_rating * 0.7 + ln(rating_count + 1) * 0.3 DESC, "movieId" LIMIT 100
""",
)
def log_blend_top_n(spark, sf):
    top = ranking.log_blend_top_n(inputs.known_movies(spark, sf), inputs.item_stats(spark, sf), 100)
    return top.select("movieId", "title", "rating_count", r6("recommendation_score"))


@query(
    "top_rated_simple",
    """
SELECT "movieId", title, year, genres, rating_count, round(avg_rating, 6) AS avg_rating FROM movie_statistics
WHERE rating_count >= 30 ORDER BY avg_rating DESC, "movieId" LIMIT 20
""",
)
def top_rated_simple(spark, sf):
    rated = joins.with_stats(inputs.known_movies(spark, sf), inputs.item_stats(spark, sf))
    top = ranking.top_rated_simple(rated, inputs.M, 20)
    return top.select("movieId", "title", "year", "genres", "rating_count", r6("avg_rating"))


@query(
    "top_rated_having",
    TOP_HAVING.format(
        ratings="cleaned_ratings",
        having="HAVING sum(n) >= 30",
        tail='ORDER BY sum(total) / sum(n) DESC, "movieId" LIMIT 10',
    ),
)
def top_rated_having(spark, sf):
    top = ranking.top_rated_having(*inputs.stored_cleaned(spark, sf), inputs.M, 10)
    return top.withColumn("avg_rating", r6("avg_rating"))


@query("genre_explode", """SELECT "movieId", title, unnest(string_split(genres, '|')) AS genre FROM raw_movies""")
def genre_explode(spark, sf):
    return ranking.explode_genres(inputs.raw_movies(spark, sf)).select("movieId", "title", "genre")


@query("genre_explode_array", 'SELECT "movieId", title, unnest(genres_array) AS genre FROM cleaned_movies')
def genre_explode_array(spark, sf):
    return ranking.explode_genres(inputs.cleaned_movies(spark, sf)).select("movieId", "title", "genre")


@query("recs_explode", "SELECT * FROM recs")
def recs_explode(spark, sf):
    return explode_recommendations(inputs.recommendation_lists(spark, sf))


@query(
    "first_row_per_item",
    'SELECT "movieId", title, genres FROM known_movies',
)
def first_row_per_item(spark, sf):
    return cleaning.one_row_per_item(inputs.raw_movies(spark, sf).where(F.col("movieId").isNotNull()))
