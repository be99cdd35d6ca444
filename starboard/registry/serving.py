"""Queries on the serving tables."""

from pyspark.sql import functions as F

from starboard.operators import joins, serving
from starboard.registry import inputs, query

PAGE = """
SELECT p.movie_id, p.user_id, p.recommendation_score, m.title, m.genres, m.year, m.rating_count
FROM (SELECT r.* FROM serving_recs r {where} ORDER BY r.recommendation_score DESC, r.movie_id, r.user_id
      LIMIT 20 OFFSET {offset}) p
JOIN serving_movies m ON p.movie_id = m.movie_id
"""
PAGE_COLUMNS = ["movie_id", "user_id", "recommendation_score", "title", "genres", "year", "rating_count"]
LAST = "(SELECT (greatest(ceil(count(*) / 20.0), 1) - 1) * 20 FROM serving_recs)"


def tables(spark, sf):
    """Recommendations without their popularity, which the movies hold too, and the movies."""
    movies, recommendations = inputs.stored_serving(spark, sf)
    return recommendations.drop("popularity_score"), movies


@query(
    "user_top_n",
    """
SELECT r.movie_id, m.title, m.genres, m.year,
       CAST(round(CAST(r.recommendation_score AS DECIMAL(18, 8)), 2) AS DOUBLE) AS predicted_rating,
       CAST(round(CAST(m.avg_rating AS DECIMAL(18, 8)), 2) AS DOUBLE) AS avg_rating, m.rating_count
FROM serving_recs r JOIN serving_movies m ON r.movie_id = m.movie_id
WHERE r.user_id = 1 ORDER BY r.recommendation_score DESC, r.movie_id LIMIT 10
""",
)
def user_top_n(spark, sf):
    recommendations, movies = tables(spark, sf)
    movies = movies.withColumn("avg_rating", F.col("avg_rating").cast("double"))
    return serving.user_top_n(recommendations, movies, 1, 10)


@query("page", PAGE.format(where="", offset=40))
def page(spark, sf):
    return serving.ranked_page(*tables(spark, sf), f"{inputs.stored_pages(spark, sf)}/ranked", 3).select(*PAGE_COLUMNS)


MIDDLE = "(SELECT floor(count(*) / 2 / 20) * 20 + 20 FROM serving_recs)"


@query("page_deep", PAGE.format(where="", offset=MIDDLE))
def page_deep(spark, sf):
    """The page after the middle of the list."""
    recommendations, movies = tables(spark, sf)
    number = recommendations.count() // 2 // 20 + 2
    folder = f"{inputs.stored_pages(spark, sf)}/ranked"
    return serving.ranked_page(recommendations, movies, folder, number).select(*PAGE_COLUMNS)


@query("page_past_end", PAGE.format(where="", offset=LAST))
def page_past_end(spark, sf):
    folder = f"{inputs.stored_pages(spark, sf)}/ranked"
    return serving.ranked_page(*tables(spark, sf), folder, 1_000_000_000).select(*PAGE_COLUMNS)


@query("page_by_ranges", PAGE.format(where="", offset=MIDDLE))
def page_by_ranges(spark, sf):
    """``page_deep`` for rows that have no index: from counts of value ranges."""
    recommendations, movies = tables(spark, sf)
    number = recommendations.count() // 2 // 20 + 2
    return serving.recommendation_page(recommendations, movies, page=number).select(*PAGE_COLUMNS)


@query(
    "page_of_genre",
    PAGE.format(
        where="JOIN serving_movies g ON r.movie_id = g.movie_id WHERE g.genres ILIKE '%small%'", offset=20
    ),
)
def page_of_genre(spark, sf):
    postings = f"{inputs.stored_pages(spark, sf)}/genres"
    found = serving.recommendation_page(*tables(spark, sf), page=2, genre="small", postings=postings)
    return found.select(*PAGE_COLUMNS)


@query(
    "page_of_user",
    PAGE.format(where="WHERE r.user_id = 1", offset=4).replace("LIMIT 20", "LIMIT 4"),
)
def page_of_user(spark, sf):
    recommendations, movies = tables(spark, sf)
    mine = serving.user_filter(recommendations, 1)
    return serving.recommendation_page(mine, movies, page=2, size=4).select(*PAGE_COLUMNS)


@query("page_after", PAGE.format(where="", offset=20))
def page_after(spark, sf):
    """The second page, from the last row of the first."""
    recommendations, movies = tables(spark, sf)
    first = serving.next_page(recommendations, movies, None)
    keys = ["recommendation_score", "movie_id", "user_id"]
    last = first.orderBy("recommendation_score", F.desc("movie_id"), F.desc("user_id")).select(*keys).first()
    return serving.next_page(recommendations, movies, list(last)).select(*PAGE_COLUMNS)


@query("page_after_deep", PAGE.format(where="", offset=MIDDLE.replace("+ 20", "+ 40")))
def page_after_deep(spark, sf):
    """The page that follows ``page_deep``, from its last row."""
    recommendations, movies = tables(spark, sf)
    number = recommendations.count() // 2 // 20 + 2
    page = serving.recommendation_page(recommendations, movies, page=number)
    keys = ["recommendation_score", "movie_id", "user_id"]
    last = page.orderBy("recommendation_score", F.desc("movie_id"), F.desc("user_id")).select(*keys).first()
    return serving.next_page(recommendations, movies, list(last)).select(*PAGE_COLUMNS)


@query(
    "serving_default_order",
    """
SELECT movie_id, title, round(CAST(avg_rating AS DOUBLE), 6) AS avg_rating, rating_count FROM serving_movies
ORDER BY serving_movies.avg_rating DESC, rating_count DESC, movie_id
""",
)
def serving_default_order(spark, sf):
    ordered = serving.movies_in_order(inputs.serving_movies(spark, sf))
    shown = F.round(F.col("avg_rating").cast("double"), 6).alias("avg_rating")
    return ordered.select("movie_id", "title", shown, "rating_count")


@query(
    "serving_top_movies",
    "SELECT movie_id, title, rating_count FROM serving_movies "
    "ORDER BY avg_rating DESC, rating_count DESC, movie_id LIMIT 10",
)
def serving_top_movies(spark, sf):
    best = serving.movies_in_order(inputs.serving_movies(spark, sf)).limit(10)
    return best.select("movie_id", "title", "rating_count")


@query(
    "serving_recommendation_order",
    "SELECT movie_id, user_id, recommendation_score FROM serving_recs ORDER BY recommendation_score DESC, movie_id, user_id",
)
def serving_recommendation_order(spark, sf):
    ordered = serving.recommendations_in_order(inputs.serving_recommendations(spark, sf))
    return ordered.select("movie_id", "user_id", "recommendation_score")


@query("dashboard_top10", PAGE.format(where="", offset=0).replace("LIMIT 20", "LIMIT 10"))
def dashboard_top10(spark, sf):
    return serving.dashboard_top(*tables(spark, sf), 10).select(*PAGE_COLUMNS)


@query("per_user_preview", 'SELECT * FROM named_recs WHERE "userId" IN (1, 2, 3, 4, 5)')
def per_user_preview(spark, sf):
    named = joins.recommendations_with_movies(inputs.recommendations(spark, sf), inputs.known_movies(spark, sf))
    return serving.users_preview(named, [1, 2, 3, 4, 5])
