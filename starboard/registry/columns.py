"""Projections, filters and scalar functions."""

from pyspark.sql import functions as F

from starboard.functions import scores, text, time, validity
from starboard.operators import cleaning, joins, quality, ranking, serving
from starboard.operators.stats import mean_of_means
from starboard.registry import inputs, query, r6


@query("year_anywhere", 'SELECT "movieId", title, year FROM movies_with_year')
def year_anywhere(spark, sf):
    return inputs.movies_with_year(spark, sf).select("movieId", "title", "year")


@query(
    "year_anchored",
    r"""
SELECT "movieId", title,
       CASE WHEN regexp_matches(title, '\([0-9]{4}\)$')
            THEN CAST(regexp_extract(title, '\(([0-9]{4})\)$', 1) AS INTEGER) END AS year
FROM raw_movies
""",
)
def year_anchored(spark, sf):
    return inputs.raw_movies(spark, sf).select("movieId", "title", text.year_anchored(F.col("title")).alias("year"))


@query("title_trim", 'SELECT "movieId", trim(title) AS title, CAST(length(title) AS INTEGER) AS raw_length FROM raw_movies')
def title_trim(spark, sf):
    return inputs.raw_movies(spark, sf).select(
        "movieId", F.trim("title").alias("title"), F.length("title").alias("raw_length")
    )


@query(
    "genres_split",
    """
SELECT "movieId", CAST(len(string_split(genres, '|')) AS INTEGER) AS parts,
       array_to_string(string_split(genres, '|'), ' / ') AS joined
FROM raw_movies
""",
)
def genres_split(spark, sf):
    parts = text.split_genres(F.col("genres"))
    return inputs.raw_movies(spark, sf).select(
        "movieId", F.size(parts).alias("parts"), F.array_join(parts, " / ").alias("joined")
    )


@query(
    "movie_validity",
    """
SELECT "movieId", title, genres,
       "movieId" IS NOT NULL AND title IS NOT NULL AND title <> '' AND genres IS NOT NULL AND genres <> ''
         AND genres <> '(no genres listed)' AS is_valid
FROM raw_movies
""",
)
def movie_validity(spark, sf):
    valid = validity.movie_is_valid(F.col("movieId"), F.col("title"), F.col("genres"))
    return inputs.raw_movies(spark, sf).withColumn("is_valid", valid)


@query(
    "rating_validity",
    """
SELECT *, coalesce("userId" IS NOT NULL AND "movieId" IS NOT NULL AND "timestamp" IS NOT NULL
                   AND rating >= 0.5 AND rating <= 5.0, FALSE) AS is_valid
FROM raw_ratings
""",
)
def rating_validity(spark, sf):
    valid = validity.rating_is_valid(F.col("userId"), F.col("movieId"), F.col("rating"), F.col("timestamp"))
    return inputs.raw_ratings(spark, sf).withColumn("is_valid", valid)


@query(
    "rating_date",
    """
SELECT "userId", "movieId", "timestamp",
       strftime(make_timestamp("timestamp" * 1000000), '%Y-%m-%d %H:%M:%S') AS rating_date
FROM raw_ratings
""",
)
def rating_date(spark, sf):
    return inputs.raw_ratings(spark, sf).select(
        "userId", "movieId", "timestamp", time.rating_date(F.col("timestamp")).alias("rating_date")
    )


@query(
    "rating_year_month",
    """
SELECT "userId", "movieId", "timestamp",
       CAST(year(make_timestamp("timestamp" * 1000000)) AS INTEGER) AS rating_year,
       CAST(month(make_timestamp("timestamp" * 1000000)) AS INTEGER) AS rating_month
FROM raw_ratings
""",
)
def rating_year_month(spark, sf):
    seconds = F.col("timestamp")
    return inputs.raw_ratings(spark, sf).select(
        "userId",
        "movieId",
        "timestamp",
        time.rating_year(seconds).alias("rating_year"),
        time.rating_month(seconds).alias("rating_month"),
    )


@query("not_null_id_filter", 'SELECT * FROM raw_movies WHERE "movieId" IS NOT NULL')
def not_null_id_filter(spark, sf):
    return inputs.raw_movies(spark, sf).where(F.col("movieId").isNotNull())


@query("rating_range_filter", "SELECT * FROM valid_ratings")
def rating_range_filter(spark, sf):
    return cleaning.valid_ratings(inputs.raw_ratings(spark, sf))


@query(
    "min_count_filter",
    'SELECT "movieId", round(avg_rating, 6) AS avg_rating, rating_count FROM stats WHERE rating_count >= 30',
)
def min_count_filter(spark, sf):
    kept = ranking.min_count_filter(inputs.item_stats(spark, sf), inputs.M)
    return kept.select("movieId", r6("avg_rating"), "rating_count")


@query("genre_filter", "SELECT movie_id, title, genres FROM serving_movies WHERE genres ILIKE '%PROMO%'")
def genre_filter(spark, sf):
    """Through the postings of the genres; the movies are looked up by id."""
    movies = inputs.stored_serving(spark, sf)[0]
    wanted = serving.movies_of_genre(movies, f"{inputs.stored_pages(spark, sf)}/genres", "PROMO")
    return movies.join(wanted, "movie_id", "left_semi").select("movie_id", "title", "genres")


@query(
    "user_filter",
    "SELECT user_id, movie_id, recommendation_score FROM serving_recs WHERE user_id = 1",
)
def user_filter(spark, sf):
    rows = serving.user_filter(inputs.serving_recommendations(spark, sf), 1)
    return rows.select("user_id", "movie_id", "recommendation_score")


@query(
    "bayesian_score",
    """
SELECT "movieId", rating_count, round(avg_rating, 6) AS avg_rating,
       round((rating_count / (rating_count + 30.0)) * avg_rating + (30.0 / (rating_count + 30.0)) * mean_rating, 6)
         AS weighted_rating
FROM stats, prior WHERE rating_count >= 30
""",
)
def bayesian_score(spark, sf):
    scored = ranking.bayesian_scores(inputs.item_stats(spark, sf), inputs.M)
    return scored.select("movieId", "rating_count", r6("avg_rating"), r6("weighted_rating"))


@query(
    "log_blend_score",
    """
SELECT "movieId", round(avg_rating * 0.7 + ln(rating_count + 1) * 0.3, 6) AS recommendation_score FROM stats
""",
)
def log_blend_score(spark, sf):
    score = scores.log_blend_score(F.col("avg_rating"), F.col("rating_count"))
    return inputs.item_stats(spark, sf).select("movieId", F.round(score, 6).alias("recommendation_score"))


@query(
    "fill_defaults",
    """
SELECT m."movieId", round(coalesce(s.avg_rating, 0.0), 6) AS avg_rating, coalesce(s.rating_count, 0) AS rating_count
FROM known_movies m LEFT JOIN stats s ON m."movieId" = s."movieId"
""",
)
def fill_defaults(spark, sf):
    filled = joins.with_stats_filled(inputs.known_movies(spark, sf), inputs.item_stats(spark, sf))
    return filled.select("movieId", r6("avg_rating"), "rating_count")


@query(
    "float_int_casts",
    """
SELECT movie_id, round(CAST(avg_rating AS DOUBLE), 6) AS avg_rating, typeof(rating_count) AS count_type, rating_count
FROM serving_movies
""",
)
def float_int_casts(spark, sf):
    return inputs.serving_movies(spark, sf).select(
        "movie_id",
        F.round(F.col("avg_rating").cast("double"), 6).alias("avg_rating"),
        F.when(F.typeof("rating_count") == "int", "INTEGER").alias("count_type"),
        "rating_count",
    )


@query(
    "round_display",
    """
SELECT "movieId", CAST(round(CAST(avg_rating AS DECIMAL(18, 8)), 2) AS DOUBLE) AS avg_rating,
       CAST(coalesce(CAST(year AS VARCHAR), 'N/A') AS VARCHAR) AS year
FROM movie_statistics
""",
)
def round_display(spark, sf):
    rows = joins.with_stats(inputs.known_movies(spark, sf), inputs.item_stats(spark, sf))
    return serving.display_top(rows).select("movieId", "avg_rating", "year")


@query(
    "constant_labels",
    """
SELECT 'raw_movies' AS table_name, 'null_check' AS check_type, "movieId", title FROM raw_movies
""",
)
def constant_labels(spark, sf):
    return quality.labelled(inputs.raw_movies(spark, sf).select("movieId", "title"), "raw_movies", "null_check")


@query(
    "load_timestamp",
    """
SELECT 'raw_ratings' AS table_name, count(*) AS total_records, TRUE AS stamped FROM raw_ratings
""",
)
def load_timestamp(spark, sf):
    stamped = F.col("check_timestamp").rlike(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$")
    report = quality.rating_quality(inputs.raw_ratings(spark, sf))
    return report.select("table_name", "total_records", stamped.alias("stamped"))


@query(
    "array_size_test",
    """
SELECT "movieId", CAST(len(genres_array) AS INTEGER) AS genre_number FROM cleaned_movies WHERE len(genres_array) > 0
""",
)
def array_size_test(spark, sf):
    size = F.size("genres_array")
    return inputs.cleaned_movies(spark, sf).where(size > 0).select("movieId", size.alias("genre_number"))


@query(
    "struct_fields",
    """
SELECT "userId", CAST(count(*) AS INTEGER) AS items, CAST(max("movieId") AS INTEGER) AS last_item,
       CAST(max(predicted_rating) AS DOUBLE) AS best
FROM recs GROUP BY "userId"
""",
)
def struct_fields(spark, sf):
    """A field of an array of structs is the array of that field."""
    return inputs.recommendation_lists(spark, sf).select(
        "userId",
        F.size("recommendations").alias("items"),
        F.array_max("recommendations.movieId").alias("last_item"),
        F.array_max("recommendations.rating").cast("double").alias("best"),
    )


@query(
    "title_format_check",
    r"""
SELECT "movieId", title, NOT regexp_matches(title, '\([0-9]{4}\)$') AS lacks_year FROM raw_movies
""",
)
def title_format_check(spark, sf):
    return inputs.raw_movies(spark, sf).select(
        "movieId", "title", text.lacks_year_suffix(F.col("title")).alias("lacks_year")
    )


@query(
    "null_to_label",
    """
SELECT "movieId", coalesce(CAST(year AS VARCHAR), 'N/A') AS year, coalesce(genres, '') AS genres FROM movies_with_year
""",
)
def null_to_label(spark, sf):
    return inputs.movies_with_year(spark, sf).select(
        "movieId",
        text.year_label(F.col("year")).alias("year"),
        text.genres_label(F.col("genres")).alias("genres"),
    )


@query("mean_of_means", "SELECT round(mean_rating, 6) AS mean_rating FROM prior")
def prior_mean(spark, sf):
    return mean_of_means(inputs.item_stats(spark, sf)).select(r6("mean_rating"))
