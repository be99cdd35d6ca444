"""The derived tables in SQL, as common table expressions put before each query's own SQL."""

import re

COMMON = r"""
parts AS MATERIALIZED (
  SELECT *, unnest(CASE WHEN p_partkey % 71 = 0 THEN [1, 2] ELSE [1] END) AS copy FROM part
),
raw_movies AS MATERIALIZED (
  SELECT CASE WHEN p_partkey % 199 <> 0 THEN CAST(p_partkey AS INTEGER) END AS "movieId",
         CASE WHEN p_partkey % 83 = 0 THEN ''
              WHEN p_partkey % 97 = 0 THEN p_name
              ELSE concat(p_name, CASE WHEN p_partkey % 5 = 0 THEN ', The' ELSE '' END,
                          ' (', CAST(1950 + p_partkey % 70 AS VARCHAR), ')',
                          CASE WHEN p_partkey % 73 = 0 THEN ' ' ELSE '' END) END AS title,
         CASE WHEN p_partkey % 79 = 0 THEN NULL
              WHEN p_partkey % 89 = 0 THEN '(no genres listed)'
              WHEN p_size % 3 = 0 THEN p_type
              WHEN p_size % 3 = 1 THEN concat(p_type, '|', split_part(p_name, ' ', 1))
              ELSE concat(p_type, '|', split_part(p_name, ' ', 1), '|', split_part(p_name, ' ', 2)) END AS genres
  FROM parts
),
lines AS MATERIALIZED (
  SELECT o_custkey, l_partkey, l_quantity, l_shipdate,
         l_orderkey * 7 + l_linenumber * 13 + l_partkey AS h
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
),
raw_ratings AS MATERIALIZED (
  SELECT CASE WHEN h % 109 = 0 THEN NULL ELSE CAST(o_custkey AS INTEGER) END AS "userId",
         CASE WHEN h % 113 = 0 THEN CAST(l_partkey + 1000000 AS INTEGER)
              ELSE CAST(l_partkey AS INTEGER) END AS "movieId",
         CASE WHEN h % 107 = 0 THEN NULL
              WHEN h % 101 = 0 THEN CAST(0.0 AS DOUBLE)
              WHEN h % 103 = 0 THEN CAST(5.5 AS DOUBLE)
              ELSE CAST(ceil(l_quantity / 5) / 2 AS DOUBLE) END AS rating,
         CASE WHEN h % 127 = 0 THEN NULL ELSE CAST(epoch(l_shipdate) AS BIGINT) END AS "timestamp"
  FROM lines
),
loose_ratings AS MATERIALIZED (
  SELECT "userId", CASE WHEN "userId" IS NOT NULL THEN "movieId" END AS "movieId",
         CASE WHEN "userId" IS NOT NULL THEN rating END AS rating,
         CASE WHEN "userId" IS NOT NULL THEN "timestamp" END AS "timestamp"
  FROM raw_ratings
),
valid_ratings AS MATERIALIZED (
  SELECT * FROM raw_ratings
  WHERE "userId" IS NOT NULL AND "movieId" IS NOT NULL AND rating IS NOT NULL AND "timestamp" IS NOT NULL
    AND rating >= 0.5 AND rating <= 5.0
),
latest_ratings AS MATERIALIZED (
  SELECT "userId", "movieId", rating, "timestamp" FROM (
    SELECT *, row_number() OVER (PARTITION BY "userId", "movieId" ORDER BY "timestamp" DESC, rating DESC) AS rn
    FROM valid_ratings) t
  WHERE rn = 1
),
movies_with_year AS MATERIALIZED (
  SELECT "movieId", title, genres,
         CAST(nullif(regexp_extract(title, '\((\d{4})\)', 1), '') AS INTEGER) AS year
  FROM raw_movies
),
known_movies AS MATERIALIZED (
  SELECT DISTINCT "movieId", title, genres, year FROM movies_with_year WHERE "movieId" IS NOT NULL
),
cleaned_movies AS MATERIALIZED (
  SELECT "movieId", trim(title) AS title,
         CASE WHEN regexp_matches(title, '\([0-9]{4}\)$')
              THEN CAST(regexp_extract(title, '\(([0-9]{4})\)$', 1) AS INTEGER) END AS year,
         string_split(genres, '|') AS genres_array,
         genres,
         coalesce(title <> '' AND genres <> '' AND genres <> '(no genres listed)', FALSE) AS is_valid
  FROM raw_movies
  WHERE "movieId" IS NOT NULL
),
dated_ratings AS MATERIALIZED (
  SELECT "userId", "movieId", rating,
         strftime(make_timestamp("timestamp" * 1000000), '%Y-%m-%d %H:%M:%S') AS rating_date,
         "timestamp", TRUE AS is_valid,
         CAST(year(make_timestamp("timestamp" * 1000000)) AS INTEGER) AS rating_year,
         CAST(month(make_timestamp("timestamp" * 1000000)) AS INTEGER) AS rating_month
  FROM valid_ratings
),
cleaned_ratings AS MATERIALIZED (
  SELECT "userId", "movieId", rating,
         strftime(make_timestamp("timestamp" * 1000000), '%Y-%m-%d %H:%M:%S') AS rating_date,
         "timestamp", TRUE AS is_valid,
         CAST(year(make_timestamp("timestamp" * 1000000)) AS INTEGER) AS rating_year,
         CAST(month(make_timestamp("timestamp" * 1000000)) AS INTEGER) AS rating_month
  FROM latest_ratings
),
stats AS MATERIALIZED (
  SELECT "movieId", avg(rating) AS avg_rating, count(rating) AS rating_count FROM valid_ratings GROUP BY "movieId"
),
prior AS MATERIALIZED (SELECT avg(avg_rating) AS mean_rating FROM stats),
movie_statistics AS MATERIALIZED (
  SELECT m."movieId", m.title, m.year, m.genres, s.rating_count, s.avg_rating
  FROM known_movies m JOIN stats s ON m."movieId" = s."movieId"
),
recs AS MATERIALIZED (
  SELECT "userId", "movieId", CAST(rating AS FLOAT) AS predicted_rating FROM (
    SELECT *, row_number() OVER (PARTITION BY "userId" ORDER BY rating DESC, "movieId") AS position
    FROM latest_ratings) t
  WHERE position <= 10
),
named_recs AS MATERIALIZED (
  SELECT r."userId", r."movieId", m.title, m.year, m.genres, r.predicted_rating
  FROM recs r JOIN known_movies m ON r."movieId" = m."movieId"
),
serving_movies AS MATERIALIZED (
  SELECT m."movieId" AS movie_id, m.title, m.genres, m.year,
         CAST(coalesce(s.avg_rating, 0.0) AS FLOAT) AS avg_rating,
         CAST(coalesce(s.rating_count, 0) AS INTEGER) AS rating_count
  FROM known_movies m LEFT JOIN stats s ON m."movieId" = s."movieId"
),
serving_recs AS MATERIALIZED (
  SELECT r."movieId" AS movie_id, r."userId" AS user_id, CAST(r.predicted_rating AS DOUBLE) AS recommendation_score,
         m.avg_rating AS popularity_score
  FROM recs r JOIN serving_movies m ON r."movieId" = m.movie_id
),
raw_dataset AS MATERIALIZED (
  SELECT s_name AS data_file, s_acctbal > 0 AS processed, CAST(s_suppkey AS INTEGER) AS record_count FROM supplier
)
"""


def _tables() -> dict[str, str]:
    """Name and text of each table of COMMON, in order."""
    parts = re.split(r"^(?=\w+ AS MATERIALIZED \()", COMMON.strip(), flags=re.M)
    return {part.split(" ", 1)[0]: part.strip().rstrip(",") for part in parts if part.strip()}


def with_tables(sql: str) -> str:
    """The SQL with the tables it names, and those they name in turn, in front."""
    tables = _tables()
    text, needed = sql, set()
    for name in reversed(tables):
        if re.search(rf"\b{name}\b", text):
            needed.add(name)
            text += tables[name]
    chosen = [tables[name] for name in tables if name in needed]
    return f"WITH {', '.join(chosen)}\n{sql.strip()}" if chosen else sql.strip()
