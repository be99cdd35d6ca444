"""Known counts of the derived tables at sf0.01."""

import pytest
from pyspark.sql import functions as F

from starboard import fixtures
from starboard.operators import quality, ranking, stats
from starboard.registry import inputs

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return inputs.raw_movies(spark, SF).cache(), inputs.raw_ratings(spark, SF).cache()


def test_movies(spark, tables):
    movies = tables[0]
    assert tuple(quality.movie_null_check(movies).first())[2:] == (2029, 12, 26, 49)
    assert quality.movie_duplicate_check(movies).first().duplicate_count == 40
    assert movies.count() - quality.movie_title_check(movies).first().missing_year_count == 1956
    assert inputs.movies_with_year(spark, SF).where("year is not null").count() == 1983
    exploded = ranking.explode_genres(movies)
    assert (exploded.count(), exploded.select("genre").distinct().count()) == (4030, 23)


def test_ratings(spark, tables):
    movies, ratings = tables
    assert tuple(quality.rating_null_check(ratings).first())[2:] == (60000, 571, 0, 571, 489)
    assert tuple(quality.rating_range_check(ratings).first())[2:] == (60000, 1087, 0.0, 5.5)
    assert tuple(quality.orphan_check(ratings, movies).first())[2:] == (2494, 505)
    assert quality.rating_pair_check(ratings).first().unique_user_movie_pairs == 58837
    latest = inputs.latest_ratings(spark, SF).agg(F.count(F.lit(1)), F.sum("rating"), F.sum("timestamp")).first()
    assert tuple(latest) == (56791, 155660.0, 50925739996800)
    months = inputs.cleaned_ratings(spark, SF).select("rating_year", "rating_month").distinct()
    assert months.count() == 83


def test_scores(spark):
    scored = ranking.bayesian_scores(stats.item_stats(inputs.valid_ratings(spark, SF)), 30)
    count, total = scored.agg(F.count(F.lit(1)), F.sum("weighted_rating")).first()
    assert count == 796 and total == pytest.approx(2180.384291, abs=1e-6)


def test_lists_take_one_exchange(spark):
    """Pairs and lists of a user are found among the user's rows, which are dealt out once."""
    ratings = [(u, m, 1.0 + m % 4, 100 + t) for u in range(5) for m in range(15) for t in range(2)]
    raw = spark.createDataFrame(ratings, "userId int, movieId int, rating double, timestamp long")
    lists = fixtures.recommendation_lists(spark, "", k=3, raw=raw)
    assert {r.userId: [x.movieId for x in r.recommendations] for r in lists.collect()} == dict.fromkeys(range(5), [3, 7, 11])
    assert lists._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1
