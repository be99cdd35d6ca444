"""Statistics and quality checks."""

from starboard.operators import cleaning, month_state, quality, serving, stats
from starboard.registry import inputs, query, r6
from starboard.registry.sinks import QUALITY_ROWS
from starboard.session import new_folder
from starboard.sinks.bucketed import distinct_pairs, write_bucketed
from starboard.sources import footers


@query("item_stats", 'SELECT "movieId", round(avg_rating, 6) AS avg_rating, rating_count FROM stats')
def item_stats(spark, sf):
    return inputs.item_stats(spark, sf).withColumn("avg_rating", r6("avg_rating"))


@query(
    "item_stddev",
    """
SELECT "movieId", round(avg(rating), 6) AS avg_rating, count(rating) AS rating_count,
       round(stddev_samp(rating), 6) AS rating_stddev
FROM valid_ratings GROUP BY "movieId"
""",
)
def item_stddev(spark, sf):
    spread = stats.item_stddev(inputs.valid_ratings(spark, sf))
    return spread.select("movieId", r6("avg_rating"), "rating_count", r6("rating_stddev"))


@query("rating_distribution", 'SELECT rating, count(*) AS "count" FROM raw_ratings GROUP BY rating')
def rating_distribution(spark, sf):
    return stats.rating_distribution(inputs.raw_ratings(spark, sf))


@query(
    "most_active_users",
    """
SELECT "userId", count(*) AS rating_count FROM valid_ratings GROUP BY "userId"
ORDER BY rating_count DESC, "userId" LIMIT 10
""",
)
def most_active_users(spark, sf):
    return stats.most_active_users(inputs.valid_ratings(spark, sf), 10)


@query(
    "most_rated_items",
    """
SELECT "movieId", title, year, rating_count FROM movie_statistics ORDER BY rating_count DESC, "movieId" LIMIT 10
""",
)
def most_rated_items(spark, sf):
    return stats.most_rated_items(inputs.valid_ratings(spark, sf), inputs.known_movies(spark, sf), 10)


@query(
    "global_counts",
    """
SELECT (SELECT count(*) FROM cleaned_movies WHERE is_valid) AS movies_count, count(*) AS ratings_count,
       count(DISTINCT "userId") AS users_count, round(coalesce(avg(rating), 0.0), 6) AS avg_rating
FROM cleaned_ratings WHERE is_valid
""",
)
def global_counts(spark, sf):
    counts = stats.global_counts(*inputs.stored_cleaned(spark, sf))
    return counts.withColumn("avg_rating", r6("avg_rating"))


@query(
    "distinct_users_items",
    'SELECT count(DISTINCT "userId") AS unique_users, count(DISTINCT "movieId") AS unique_movies FROM raw_ratings',
)
def distinct_users_items(spark, sf):
    return stats.distinct_users_items(inputs.raw_ratings(spark, sf))


@query(
    "movie_null_check",
    """
SELECT 'raw_movies' AS table_name, 'null_check' AS check_type, count(*) AS total_records,
       count(*) FILTER (WHERE "movieId" IS NULL) AS "null_movieId",
       count(*) FILTER (WHERE title IS NULL OR title = '') AS null_title,
       count(*) FILTER (WHERE genres IS NULL OR genres = '' OR genres = '(no genres listed)') AS null_or_missing_genres
FROM raw_movies
""",
)
def movie_null_check(spark, sf):
    return quality.movie_null_check(inputs.raw_movies(spark, sf))


@query(
    "movie_duplicate_check",
    """
SELECT 'raw_movies' AS table_name, 'duplicate_check' AS check_type, count(*) AS total_records,
       count(DISTINCT "movieId") AS unique_movies, count(*) - count(DISTINCT "movieId") AS duplicate_count
FROM raw_movies
""",
)
def movie_duplicate_check(spark, sf):
    return quality.movie_duplicate_check(inputs.raw_movies(spark, sf))


@query(
    "movie_title_check",
    r"""
SELECT 'raw_movies' AS table_name, 'title_format_check' AS check_type, count(*) AS total_records,
       count(*) FILTER (WHERE NOT regexp_matches(title, '\([0-9]{4}\)$')) AS missing_year_count
FROM raw_movies
""",
)
def movie_title_check(spark, sf):
    return quality.movie_title_check(inputs.raw_movies(spark, sf))


@query(
    "rating_null_check",
    """
SELECT 'raw_ratings' AS table_name, 'null_check' AS check_type, count(*) AS total_records,
       count(*) FILTER (WHERE "userId" IS NULL) AS "null_userId",
       count(*) FILTER (WHERE "movieId" IS NULL) AS "null_movieId",
       count(*) FILTER (WHERE rating IS NULL) AS null_rating,
       count(*) FILTER (WHERE "timestamp" IS NULL) AS null_timestamp
FROM raw_ratings
""",
)
def rating_null_check(spark, sf):
    return quality.rating_null_check(inputs.raw_ratings(spark, sf))


@query(
    "rating_range_check",
    """
SELECT 'raw_ratings' AS table_name, 'rating_range_check' AS check_type, count(*) AS total_records,
       count(*) FILTER (WHERE rating < 0.5 OR rating > 5.0) AS out_of_range_count,
       min(rating) AS min_rating, max(rating) AS max_rating
FROM raw_ratings
""",
)
def rating_range_check(spark, sf):
    return quality.rating_range_check(inputs.raw_ratings(spark, sf))


PAIRS = 'count(DISTINCT ("userId", "movieId")) FILTER (WHERE "userId" IS NOT NULL AND "movieId" IS NOT NULL)'


@query(
    "rating_pair_check",
    f"""
SELECT 'raw_ratings' AS table_name, 'duplicate_ratings_check' AS check_type, count(*) AS total_records,
       {PAIRS} AS unique_user_movie_pairs, count(*) - {PAIRS} AS duplicate_ratings_count
FROM raw_ratings
""",
)
def rating_pair_check(spark, sf):
    return quality.rating_pair_check(inputs.raw_ratings(spark, sf))


@query(
    "orphan_check",
    """
SELECT 'raw_ratings' AS table_name, 'orphan_ratings_check' AS check_type,
       count(DISTINCT r."movieId") AS total_rated_movies,
       count(DISTINCT CASE WHEN m."movieId" IS NULL THEN r."movieId" END) AS orphan_movie_count
FROM raw_ratings r LEFT JOIN raw_movies m ON r."movieId" = m."movieId"
""",
)
def orphan_check(spark, sf):
    return quality.orphan_check(inputs.raw_ratings(spark, sf), inputs.raw_movies(spark, sf))


@query("quality_report", QUALITY_ROWS)
def quality_report(spark, sf):
    report = quality.quality_report(inputs.raw_movies(spark, sf), inputs.raw_ratings(spark, sf))
    return report.drop("check_timestamp")


@query(
    "verify_movies",
    """
SELECT 'cleaned_movies' AS table_name, count(*) AS total_records,
       count(*) FILTER (WHERE is_valid) AS valid_records, count(*) FILTER (WHERE NOT is_valid) AS invalid_records,
       count(DISTINCT "movieId") AS unique_movies, count(year) AS records_with_year,
       count(*) FILTER (WHERE len(genres_array) > 0) AS records_with_genres
FROM cleaned_movies
""",
)
def verify_movies(spark, sf):
    return quality.verify_movies(inputs.cleaned_movies(spark, sf))


@query(
    "verify_ratings",
    """
SELECT 'cleaned_ratings' AS table_name, count(*) AS total_records,
       count(*) FILTER (WHERE is_valid) AS valid_records, count(*) FILTER (WHERE NOT is_valid) AS invalid_records,
       count(DISTINCT "userId") AS unique_users, count(DISTINCT "movieId") AS unique_movies,
       min(rating) AS min_rating, max(rating) AS max_rating, round(avg(rating), 6) AS avg_rating
FROM cleaned_ratings
""",
)
def verify_ratings(spark, sf):
    return quality.verify_ratings(inputs.cleaned_ratings(spark, sf)).withColumn("avg_rating", r6("avg_rating"))


@query(
    "ratings_by_month",
    """
SELECT rating_year, rating_month, count(*) AS rating_count, count(DISTINCT "userId") AS unique_users,
       round(avg(rating), 6) AS avg_rating
FROM cleaned_ratings GROUP BY rating_year, rating_month ORDER BY rating_year DESC, rating_month DESC LIMIT 20
""",
)
def ratings_by_month(spark, sf):
    months = quality.ratings_by_month(inputs.cleaned_ratings(spark, sf), 20)
    return months.withColumn("avg_rating", r6("avg_rating"))


@query(
    "quality_summary",
    """
SELECT m.*, r.*,
       round(total_ratings / unique_users, 6) AS ratings_per_user,
       round(total_ratings / unique_movies, 6) AS ratings_per_movie
FROM (
  SELECT count(*) AS total_movies, count(year) AS movies_with_year,
         count(*) FILTER (WHERE len(genres_array) > 0) AS movies_with_genres,
         CAST(round(CAST(count(year) * 100.0 / count(*) AS DECIMAL(18, 8)), 2) AS DOUBLE) AS year_percentage,
         CAST(round(CAST(count(*) FILTER (WHERE len(genres_array) > 0) * 100.0 / count(*) AS DECIMAL(18, 8)), 2)
              AS DOUBLE) AS genres_percentage
  FROM cleaned_movies WHERE is_valid) m,
 (SELECT count(*) AS total_ratings, count(DISTINCT "userId") AS unique_users, round(avg(rating), 6) AS avg_rating,
         count(DISTINCT "movieId") AS unique_movies
  FROM cleaned_ratings WHERE is_valid) r
""",
)
def quality_summary(spark, sf):
    summary = quality.quality_summary(
        inputs.cleaned_movies(spark, sf).where("is_valid"), inputs.cleaned_ratings(spark, sf).where("is_valid")
    )
    return summary.withColumns({c: r6(c) for c in ("avg_rating", "ratings_per_user", "ratings_per_movie")})


@query(
    "before_after_compare",
    f"""
SELECT 'movies' AS table_name, 'raw' AS stage, count(*) AS record_count, count(DISTINCT "movieId") AS unique_count
FROM raw_movies
UNION ALL SELECT 'movies', 'cleaned', count(*), count(DISTINCT "movieId") FROM cleaned_movies
UNION ALL SELECT 'ratings', 'raw', count(*), {PAIRS} FROM raw_ratings
UNION ALL SELECT 'ratings', 'cleaned', count(*), {PAIRS} FROM cleaned_ratings
""",
)
def before_after_compare(spark, sf):
    return quality.before_after_compare(
        inputs.raw_movies(spark, sf),
        inputs.cleaned_movies(spark, sf),
        inputs.raw_ratings(spark, sf),
        inputs.cleaned_ratings(spark, sf),
    )


VERIFICATION = """
SELECT "check", table_name, CAST(amount AS DOUBLE) AS amount,
       CASE WHEN "check" = 'valid_percent' THEN CASE WHEN amount >= 95 THEN 'PASS' ELSE 'WARN' END
            WHEN amount > 0 THEN 'PASS' ELSE 'FAIL' END AS status
FROM (
  SELECT 'rows' AS "check", 'raw_movies' AS table_name, CAST(count(*) AS DOUBLE) AS amount FROM raw_movies
  UNION ALL SELECT 'rows', 'raw_ratings', count(*) FROM raw_ratings
  UNION ALL
  SELECT unnest(['rows', 'valid_rows', 'valid_percent']), 'cleaned_movies',
         unnest([count(*), count(*) FILTER (is_valid),
                 CAST(round(CAST(count(*) FILTER (is_valid) * 100.0 / count(*) AS DECIMAL(18, 8)), 2) AS DOUBLE)])
  FROM cleaned_movies
  UNION ALL
  SELECT unnest(['rows', 'valid_rows', 'valid_percent', 'months']), 'cleaned_ratings',
         unnest([count(*), count(*) FILTER (is_valid),
                 CAST(round(CAST(count(*) FILTER (is_valid) * 100.0 / count(*) AS DECIMAL(18, 8)), 2) AS DOUBLE),
                 count(DISTINCT (rating_year, rating_month))])
  FROM cleaned_ratings
) f
"""


@query("verification_report", VERIFICATION)
def verification_report(spark, sf):
    return quality.verification_report(
        inputs.raw_movies(spark, sf),
        inputs.raw_ratings(spark, sf),
        inputs.cleaned_movies(spark, sf),
        inputs.cleaned_ratings(spark, sf),
    )


@query(
    "dashboard_totals",
    """
SELECT count(*) AS total_movies, (SELECT count(*) FROM serving_recs) AS total_recommendations,
       (SELECT count(*) FROM raw_dataset) AS total_datasets,
       (SELECT count(*) FROM raw_dataset WHERE processed) AS processed_datasets,
       round(coalesce(avg(CAST(avg_rating AS DOUBLE)), 0.0), 6) AS avg_rating
FROM serving_movies
""",
)
def dashboard_totals(spark, sf):
    totals = serving.dashboard_totals(
        inputs.serving_movies(spark, sf), inputs.serving_recommendations(spark, sf), inputs.raw_dataset(spark, sf)
    )
    return totals.withColumn("avg_rating", r6("avg_rating"))


@query(
    "import_statistics",
    """
SELECT (SELECT count(*) FROM serving_movies) AS total_movies, count(*) AS total_recommendations,
       count(DISTINCT user_id) AS unique_users, round(count(*) / count(DISTINCT user_id), 6) AS recs_per_user
FROM serving_recs
""",
)
def import_statistics(spark, sf):
    imported = serving.import_statistics(inputs.serving_movies(spark, sf), inputs.serving_recommendations(spark, sf))
    return imported.withColumn("recs_per_user", r6("recs_per_user"))


@query(
    "distinct_genres",
    """
SELECT DISTINCT unnest(string_split(genres, '|')) AS genre FROM serving_movies WHERE genres <> ''
""",
)
def distinct_genres(spark, sf):
    return serving.distinct_genres(inputs.serving_movies(spark, sf))


@query(
    "stored_months",
    """
SELECT rating_year, rating_month, count(*) AS rating_count, count(DISTINCT "userId") AS unique_users,
       round(avg(rating), 6) AS avg_rating
FROM cleaned_ratings GROUP BY rating_year, rating_month ORDER BY rating_year DESC, rating_month DESC LIMIT 20
""",
)
def stored_months(spark, sf):
    """``ratings_by_month`` from stored sums and bitmaps."""
    months = month_state.stored_ratings_by_month(spark, inputs.stored_months(spark, sf), 20)
    return months.withColumn("avg_rating", r6("avg_rating"))


@query(
    "stored_totals",
    """
SELECT 'cleaned_ratings' AS table_name, count(*) AS total_records,
       count(*) FILTER (WHERE is_valid) AS valid_records, count(*) FILTER (WHERE NOT is_valid) AS invalid_records,
       count(DISTINCT "userId") AS unique_users, count(DISTINCT "movieId") AS unique_movies,
       min(rating) AS min_rating, max(rating) AS max_rating, round(avg(rating), 6) AS avg_rating
FROM cleaned_ratings
""",
)
def stored_totals(spark, sf):
    """``verify_ratings`` from the same state: users and items of all months are an OR of bitmaps."""
    return month_state.stored_totals(spark, inputs.stored_months(spark, sf)).withColumn("avg_rating", r6("avg_rating"))


@query(
    "footer_totals",
    """
SELECT count(*) AS rows, count(*) - count("userId") AS "null_userId", count(*) - count("movieId") AS "null_movieId",
       count(*) - count(rating) AS null_rating, count(*) - count("timestamp") AS null_timestamp,
       min(rating) AS min_rating, max(rating) AS max_rating, min("timestamp") AS min_timestamp, max("timestamp") AS max_timestamp
FROM raw_ratings
""",
)
def footer_totals(spark, sf):
    """Rows, nulls and ranges of the stored raw ratings, from the files' footers."""
    path = f"{inputs.stored_raw(spark, sf)}/ratings"
    return footers.footer_totals(spark, path, ["userId", "movieId", "rating", "timestamp"], ["rating", "timestamp"])


def _bucketed(spark, sf):
    folder = new_folder(spark, "bucketed")
    name = folder.rsplit("/", 1)[-1].replace("-", "_")
    return write_bucketed(inputs.raw_ratings(spark, sf), name, folder, ["userId", "movieId"], None, ["userId", "movieId", "timestamp"])


@query("bucketed_pairs", f"SELECT count(*) AS total, {PAIRS} AS pairs FROM raw_ratings")
def bucketed_pairs(spark, sf):
    """Distinct pairs of a table that is dealt out by pair."""
    return distinct_pairs(_bucketed(spark, sf))


@query("bucketed_latest", "SELECT * FROM latest_ratings")
def bucketed_latest(spark, sf):
    """The latest rating of each pair of such a table."""
    return cleaning.dedup_latest(cleaning.valid_ratings(_bucketed(spark, sf)))
