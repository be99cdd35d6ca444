import random
from collections import defaultdict

import pytest
from conftest import final_plan, rows
from pyspark.sql import functions as F

from starboard.operators import joins, ranking, stats
from starboard.schemas import RAW_RATINGS
from starboard.session import filtering_session

MOVIES = "movieId int, title string, year int, genres string"


@pytest.fixture(scope="module")
def ratings(spark):
    """One movie holds a third of all ratings."""
    rng = random.Random(5)
    data = [(u, 1, rng.randint(1, 10) / 2, u) for u in range(1000)]
    data += [(rng.randint(0, 200), rng.randint(2, 80), rng.randint(1, 10) / 2, t) for t in range(2000)]
    return data, spark.createDataFrame(data, RAW_RATINGS)


@pytest.fixture(scope="module")
def movies(spark):
    data = [(i, f"m{i}", 1990 + i % 5, "A|B" if i % 2 else "B|C") for i in range(1, 70)]
    return data, spark.createDataFrame(data, MOVIES)


def means(data):
    by = defaultdict(list)
    for _, i, r, _ in data:
        by[i].append(r)
    return {i: (sum(v) / len(v), len(v)) for i, v in by.items()}


def test_item_stats(ratings):
    data, df = ratings
    got = {i: (a, n) for i, a, n in rows(stats.item_stats(df), "movieId", "avg_rating", "rating_count")}
    assert got == means(data)


def test_null_ratings_are_not_counted(spark):
    df = spark.createDataFrame([(1, 1, 4.0, 1), (2, 1, None, 1), (3, 2, None, 1)], RAW_RATINGS)
    assert rows(stats.item_stats(df), "movieId", "avg_rating", "rating_count") == [(1, 4.0, 1), (2, None, 0)]
    assert stats.mean_of_means(stats.item_stats(df)).first()[0] == 4.0


def test_prior_is_mean_of_all_items_means(ratings, movies):
    data, df = ratings
    want = means(data)
    prior = sum(a for a, _ in want.values()) / len(want)
    top = ranking.bayesian_top_n(movies[1], stats.item_stats(df), m=20, n=1000).collect()
    known = {m[0] for m in movies[0]}
    scored = {i: n / (n + 20) * a + 20 / (n + 20) * prior for i, (a, n) in want.items() if n >= 20 and i in known}
    assert {r.movieId for r in top} == set(scored)
    for r in top:
        assert r.weighted_rating == pytest.approx(scored[r.movieId])
    assert [r.weighted_rating for r in top] == sorted((r.weighted_rating for r in top), reverse=True)


def test_ratings_are_shuffled_once_for_score_and_prior(ratings, movies, spark, folder):
    ratings[1].write.parquet(folder)
    valid = spark.read.parquet(folder).where("movieId is not null")
    plan = final_plan(ranking.bayesian_top_n(movies[1], stats.item_stats(valid), m=20, n=10))
    assert "ReusedExchange" in plan
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert "TakeOrderedAndProject" in plan


def test_equal_ranks_go_by_id(spark):
    movies = spark.createDataFrame([(i, "t", 2000, "G") for i in (3, 1, 2)], MOVIES)
    rated = spark.createDataFrame([(i, 4.0, 10) for i in (1, 2, 3)], "movieId int, avg_rating double, rating_count long")
    assert [r.movieId for r in ranking.bayesian_top_n(movies, rated, m=1, n=2).collect()] == [1, 2]
    best = ranking.genre_top_k(movies, rated, m=1, k=2)
    assert rows(best, "movieId", "rank") == [(1, 1), (2, 2)]


@pytest.mark.parametrize("threshold", ["1000", "2"])
def test_genre_top_k_by_brute_force(spark, ratings, movies, threshold):
    """The same rows whether Spark's own group limit or the slices cut the groups."""
    old = spark.conf.get(ranking.GROUP_LIMIT_SETTING)
    spark.conf.set(ranking.GROUP_LIMIT_SETTING, threshold)
    try:
        df = ranking.genre_top_k(movies[1], stats.item_stats(ratings[1]), m=5, k=7)
        got, plan = rows(df, "genre", "rank", "movieId"), final_plan(df)
    finally:
        spark.conf.set(ranking.GROUP_LIMIT_SETTING, old)
    want, rated = [], means(ratings[0])
    for genre in "ABC":
        pool = [(-rated[i][0], -rated[i][1], i) for i, _, _, g in movies[0] if genre in g and rated.get(i, (0, 0))[1] >= 5]
        want += [(genre, k, i) for k, (_, _, i) in enumerate(sorted(pool)[:7], 1)]
    assert got == sorted(want)
    assert ("WindowGroupLimit" in plan) == (threshold == "1000")


def test_grouping_over_repeated_movies(spark):
    """Joining first and grouping afterwards would count a repeated movie's ratings twice; so does this."""
    movies = spark.createDataFrame([(1, "a", 2000, "G"), (1, "a", 2000, "G"), (1, "b", None, None), (2, "c", 1, "")], MOVIES)
    df = spark.createDataFrame([(1, 1, 4.0, 1), (2, 1, 2.0, 1), (1, 3, 1.0, 1), (1, 2, None, 1)], RAW_RATINGS)
    dims = ["movieId", "title", "year", "genres"]
    joined = movies.join(df, "movieId").groupBy(*dims)
    want = joined.agg(F.count("rating").alias("rating_count"), F.avg("rating").alias("avg_rating"))
    got = joins.grouped_by_movie(movies, df, dims)
    assert rows(got.select(want.columns)) == rows(want)


def test_left_join_with_filter_is_inner(spark):
    movies = spark.createDataFrame(
        [(1, "a", 2000, True), (2, "b", 2000, True), (3, "c", 2000, False)],
        "movieId int, title string, year int, is_valid boolean",
    )
    df = spark.createDataFrame([(1, 4.0, True), (1, 1.0, False), (3, 5.0, True)], "movieId int, rating double, is_valid boolean")
    top = joins.valid_left_join_counts(movies, df, 0, 10)
    assert rows(top, "movieId", "rating_count", "avg_rating") == [(1, 1, 4.0)]
    assert "LeftOuter" not in final_plan(top)


def test_orphans_and_skipped(spark):
    movies = spark.createDataFrame([(1,), (1,), (None,)], "movieId int")
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (1, 3), (1, None)], "userId int, movieId int")
    assert rows(joins.orphan_items(df, movies)) == [(2,), (3,)]
    assert joins.count_unknown_items(df, movies).first()[0] == 4
    assert rows(joins.known_items(df, movies), "userId", "movieId") == [(1, 1)]
    empty = df.where("userId > 100")
    assert joins.count_unknown_items(empty, movies).first()[0] == 0


def test_broadcast_only_within_the_limit(spark, movies):
    side = spark.createDataFrame([(1, 2.0, 3)], "movieId int, avg_rating double, rating_count long")
    big = "NoBroadcast"
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        small = final_plan(joins.join_broadcast_hint(movies[1], side, limit=1_000_000))
        big = final_plan(joins.join_broadcast_hint(movies[1], side, limit=1))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
    assert "BroadcastHashJoin" in small
    assert "Broadcast" not in big


def test_measured_bytes_grows_with_the_text(spark):
    one = spark.createDataFrame([("a" * 1000, [1, 2], 1)], "s string, a array<int>, i int")
    assert joins.measured_bytes(one) >= 1000
    assert joins.measured_bytes(one.limit(0)) == 0


def test_skewed_recommendations_are_split(spark):
    """One movie recommended to very many users: AQE cuts its partition in the join with the movies."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        hot = spark.range(40000).select(F.col("id").cast("int").alias("userId"), F.lit(1).alias("movieId"))
        rest = spark.range(20000).select(F.col("id").cast("int").alias("userId"), (F.col("id") % 500).cast("int").alias("movieId"))
        recs = hot.union(rest).repartition(8).withColumn("predicted_rating", F.lit(4.0).cast("float"))
        movies = spark.range(500).select(
            F.col("id").cast("int").alias("movieId"), F.lit("t").alias("title"), F.lit(1).alias("year"), F.lit("g").alias("genres")
        )
        df = joins.recommendations_with_movies(recs, movies)
        plan, n = final_plan(df), df.count()
    finally:
        for key in settings:
            spark.conf.unset(key)
    assert n == 60000
    assert "skew=true" in plan


def test_global_counts_of_nothing(spark):
    movies = spark.createDataFrame([], "movieId int, is_valid boolean")
    df = spark.createDataFrame([], "userId int, movieId int, rating double, is_valid boolean")
    assert tuple(stats.global_counts(movies, df).first()) == (0, 0, 0, 0.0)


def test_attach_scalar_is_no_join(spark, ratings):
    rated = stats.item_stats(ratings[1])
    plan = final_plan(joins.attach_scalar(rated, stats.mean_of_means(rated), "c"))
    assert "Join" not in plan and "Subquery" in plan


def shuffled_rows(df):
    """Rows that each exchange of the executed plan has written, largest first."""
    df.collect()
    found = []

    def walk(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if "QueryStage" in name:
            return walk(node.plan())
        if name.startswith("Exchange"):
            found.append(node.metrics().apply("shuffleRecordsWritten").value())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return sorted(found, reverse=True)


def test_runtime_filter_before_the_shuffle(spark, folder):
    rng = random.Random(2)
    recs = [(u, rng.randrange(2000), 1.0) for u in range(400) for _ in range(50)]
    movies = [(i, f"m{i}", "Drama|Rare" if i % 100 == 7 else "Drama") for i in range(2000)]
    spark.createDataFrame(recs, "user_id int, movie_id int, recommendation_score double").write.parquet(f"{folder}/recs")
    spark.createDataFrame(movies, "movie_id int, title string, genres string").write.parquet(f"{folder}/movies")
    paths = f"{folder}/recs", f"{folder}/movies"
    plain = filtering_session(spark, large_from="1TB", broadcast_up_to="-1")
    filtered = filtering_session(spark, large_from="0B", broadcast_up_to="-1")
    before, after = (joins.recommendations_of_genre(s, *paths, "rare") for s in (plain, filtered))
    assert rows(before) == rows(after) and before.count() > 100
    assert "might_contain" in final_plan(after) and "might_contain" not in final_plan(before)
    counts = shuffled_rows(before)[0], shuffled_rows(after)[0]
    print("rows of the large side shuffled:", *counts)
    assert counts[0] == 20_000 and counts[1] < 1_000
