"""Joins."""

from starboard.operators import joins, serving, stats
from starboard.registry import inputs, query, r6
from starboard.registry.ranking import TOP_HAVING
from starboard.session import filtering_session, new_folder
from starboard.sinks.files import write_table_folder


@query(
    "join_inner_stats",
    """
SELECT m."movieId", m.title, m.genres, m.year, round(s.avg_rating, 6) AS avg_rating, s.rating_count
FROM movies_with_year m JOIN stats s ON m."movieId" = s."movieId"
""",
)
def join_inner_stats(spark, sf):
    joined = joins.with_stats(inputs.movies_with_year(spark, sf), inputs.item_stats(spark, sf))
    return joined.withColumn("avg_rating", r6("avg_rating"))


@query(
    "join_left_stats_filled",
    """
SELECT m."movieId", m.title, m.genres, m.year, round(coalesce(s.avg_rating, 0.0), 6) AS avg_rating,
       coalesce(s.rating_count, 0) AS rating_count
FROM movies_with_year m LEFT JOIN stats s ON m."movieId" = s."movieId"
""",
)
def join_left_stats_filled(spark, sf):
    joined = joins.with_stats_filled(inputs.movies_with_year(spark, sf), inputs.item_stats(spark, sf))
    return joined.withColumn("avg_rating", r6("avg_rating"))


@query(
    "join_left_orphans",
    """
SELECT DISTINCT r."movieId" FROM raw_ratings r LEFT JOIN raw_movies m ON r."movieId" = m."movieId"
WHERE m."movieId" IS NULL AND r."movieId" IS NOT NULL
""",
)
def join_left_orphans(spark, sf):
    return joins.orphan_items(inputs.raw_ratings(spark, sf), inputs.raw_movies(spark, sf))


@query("join_fact_dim_group", TOP_HAVING.format(ratings="cleaned_ratings", having="", tail=""))
def join_fact_dim_group(spark, sf):
    dims = ["movieId", "title", "year", "genres"]
    movies = inputs.cleaned_movies(spark, sf).where("is_valid")
    ratings = inputs.cleaned_ratings(spark, sf).where("is_valid")
    return joins.grouped_by_movie(movies, ratings, dims).withColumn("avg_rating", r6("avg_rating"))


@query(
    "join_left_as_inner",
    """
SELECT "movieId", title, year, CAST(sum(n) AS BIGINT) AS rating_count, round(sum(total) / sum(n), 6) AS avg_rating
FROM (SELECT * FROM cleaned_movies WHERE is_valid) m
JOIN (SELECT "movieId", count(rating) AS n, sum(rating) AS total FROM cleaned_ratings WHERE is_valid GROUP BY "movieId") rated USING ("movieId")
GROUP BY ALL HAVING sum(n) >= 30 ORDER BY sum(total) / sum(n) DESC, "movieId" LIMIT 10
""",
)
def join_left_as_inner(spark, sf):
    top = joins.valid_left_join_counts(inputs.cleaned_movies(spark, sf), inputs.cleaned_ratings(spark, sf), inputs.M, 10)
    return top.withColumn("avg_rating", r6("avg_rating"))


@query(
    "join_agg_then_dim",
    'SELECT "movieId", title, year, genres, rating_count, round(avg_rating, 6) AS avg_rating FROM movie_statistics',
)
def join_agg_then_dim(spark, sf):
    rated = joins.with_stats(inputs.known_movies(spark, sf), inputs.item_stats(spark, sf))
    return rated.select("movieId", "title", "year", "genres", "rating_count", r6("avg_rating"))


@query("join_recs_movies", "SELECT * FROM named_recs")
def join_recs_movies(spark, sf):
    return joins.recommendations_with_movies(inputs.recommendations(spark, sf), inputs.known_movies(spark, sf))


@query(
    "recs_of_genre",
    """
SELECT r.user_id, r.movie_id, m.title, r.recommendation_score
FROM serving_recs r JOIN serving_movies m ON r.movie_id = m.movie_id WHERE m.genres ILIKE '%promo%'
""",
)
def recs_of_genre(spark, sf):
    """With the Bloom filter and without broadcast, which tables this small would not get by themselves."""
    movies, recommendations = (t.inputFiles()[0].rsplit("/", 1)[0] for t in inputs.stored_serving(spark, sf))
    session = filtering_session(spark, large_from="0B", broadcast_up_to="-1")
    return joins.recommendations_of_genre(session, recommendations, movies, "promo")


@query(
    "semi_known_movies",
    'SELECT "userId", "movieId", predicted_rating FROM recs WHERE "movieId" IN (SELECT "movieId" FROM known_movies)',
)
def semi_known_movies(spark, sf):
    return joins.known_items(inputs.recommendations(spark, sf), inputs.known_movies(spark, sf))


@query(
    "anti_skipped",
    'SELECT count(*) AS skipped FROM recs WHERE "movieId" NOT IN (SELECT "movieId" FROM known_movies)',
)
def anti_skipped(spark, sf):
    return joins.count_unknown_items(inputs.recommendations(spark, sf), inputs.known_movies(spark, sf))


@query(
    "join_serving_lookup",
    """
SELECT r.movie_id, r.user_id, r.recommendation_score, m.title, m.genres, m.year, m.rating_count
FROM serving_recs r JOIN serving_movies m ON r.movie_id = m.movie_id
""",
)
def join_serving_lookup(spark, sf):
    found = serving.lookup_movies(
        inputs.serving_recommendations(spark, sf).drop("popularity_score"), inputs.serving_movies(spark, sf)
    )
    return found.select("movie_id", "user_id", "recommendation_score", "title", "genres", "year", "rating_count")


@query(
    "join_broadcast_hint",
    """
SELECT m."movieId", m.title, round(s.avg_rating, 6) AS avg_rating, s.rating_count
FROM known_movies m LEFT JOIN stats s ON m."movieId" = s."movieId"
""",
)
def join_broadcast_hint(spark, sf):
    folder = new_folder(spark, "item_stats")
    write_table_folder(inputs.item_stats(spark, sf), folder)
    joined = joins.join_broadcast_hint(inputs.known_movies(spark, sf), spark.read.parquet(folder))
    return joined.select("movieId", "title", r6("avg_rating"), "rating_count")


@query(
    "cross_scalar",
    """
SELECT "movieId", round(avg_rating, 6) AS avg_rating, round(mean_rating, 6) AS mean_rating FROM stats, prior
""",
)
def cross_scalar(spark, sf):
    rated = inputs.item_stats(spark, sf)
    attached = joins.attach_scalar(rated, stats.mean_of_means(rated), "mean_rating")
    return attached.select("movieId", r6("avg_rating"), r6("mean_rating"))
