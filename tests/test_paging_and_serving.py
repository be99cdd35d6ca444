import os
import random

import pytest
from conftest import final_plan, rows
from pyspark.sql import functions as F

from starboard.operators import paging, serving
from starboard.operators.paging import Order, clamp_page, numbered_page, page_after
from starboard.sinks import serving as sink
from starboard.sinks import versions
from starboard.sinks.ranked import write_genre_postings, write_ranked

ORDER = [Order("score", descending=True), Order("id")]


@pytest.fixture(scope="module")
def scored(spark):
    """A third of the rows have the same score."""
    rng = random.Random(3)
    data = [(i, 4.0 if i % 3 == 0 else rng.randint(0, 500) / 100) for i in range(3001)]
    rng.shuffle(data)
    return sorted(data, key=lambda r: (-r[1], r[0])), spark.createDataFrame(data, "id int, score double").repartition(8)


@pytest.mark.parametrize("page, want", [(1, 1), ("2", 2), (6, 6), (7, 6), (0, 6), (-3, 6), (None, 1), ("x", 1)])
def test_clamp_page(page, want):
    assert clamp_page(page, 101, 20) == want
    assert clamp_page(page, 0, 20) == 1


@pytest.mark.parametrize("page", [1, 2, 30, 75, 150, 151, 99999])
def test_numbered_page_by_brute_force(scored, page):
    data, df = scored
    got = [tuple(r) for r in numbered_page(df, ORDER, page).collect()]
    start = (clamp_page(page, len(data)) - 1) * 20
    assert got == data[start : start + 20]


@pytest.mark.parametrize("descending", [True, False])
def test_nulls_come_last_on_every_kind_of_page(spark, descending):
    data = [(i, None if i % 3 else i % 7 / 2) for i in range(200)]
    sign = -1 if descending else 1
    want = sorted(data, key=lambda r: (r[1] is None, sign * (r[1] or 0), r[0]))
    df = spark.createDataFrame(data, "id int, score double").repartition(5)
    order = [Order("score", descending), Order("id")]
    pages, last = [], None
    for number in range(1, 11):
        page = [tuple(r) for r in numbered_page(df, order, number).collect()]
        assert page == [tuple(r) for r in page_after(df, order, last).collect()]
        pages += page
        last = [page[-1][1], page[-1][0]]
    assert pages == want


def test_deep_page_narrows_to_a_small_range(scored, monkeypatch):
    """Also among the rows with the one frequent score."""
    seen, ranges = [], paging._ranges

    def watched(df, column):
        seen.append(df.count())
        return ranges(df, column)

    monkeypatch.setattr(paging, "_ranges", watched)
    data, df = scored
    page = next(i for i, r in enumerate(data) if r[1] == 4.0) // 20 + 25
    assert numbered_page(df, ORDER, page).count() == 20
    assert seen[0] == 3001 and seen[-1] < 1100 and len(seen) < 9


def test_keyset_pages_make_the_whole(scored):
    data, df = scored
    df = df.where("score > 4.9 or score = 4.0").cache()
    want = [r for r in data if r[1] > 4.9 or r[1] == 4.0]
    got, last = [], None
    for _ in range(4):
        page = [tuple(r) for r in page_after(df, ORDER, last).collect()]
        got += page
        last = [page[-1][1], page[-1][0]]
    assert got == want[:80]
    assert page_after(df, ORDER, [want[-1][1], want[-1][0]]).count() == 0
    assert "TakeOrderedAndProject" in final_plan(page_after(df, ORDER, last))


def test_page_of_nothing(spark):
    empty = spark.createDataFrame([], "id int, score double")
    assert numbered_page(empty, ORDER, 5).count() == 0


@pytest.mark.parametrize("rows_per_file", [7, 500, 10**6])
def test_indexed_pages_by_brute_force(scored, spark, folder, rows_per_file):
    data, df = scored
    write_ranked(df, ORDER, folder, rows_per_file)
    for page in (1, 2, 75, 150, 151, 99999, "x"):
        got = [tuple(r) for r in paging.indexed_page(spark, folder, ORDER, page).collect()]
        start = (clamp_page(page, len(data)) - 1) * 20
        assert got == data[start : start + 20]


def test_indexed_page_opens_one_file(scored, spark, folder):
    data, df = scored
    write_ranked(df, ORDER, folder, 200)
    files = spark.read.parquet(f"{folder}/rows").inputFiles()
    assert len(files) >= 15
    page = paging.indexed_page(spark, folder, ORDER, 40)
    assert len(page.inputFiles()) <= 2 and len(paging.indexed_page(spark, folder, ORDER, 1).inputFiles()) == 1
    executed = final_plan(page).split("Initial Plan")[0]
    assert executed.count("FileScan") == 1 and "row_index" in executed


def test_indexed_page_with_nulls_and_of_nothing(spark, folder):
    data = [(i, None if i % 3 else i % 7 / 2) for i in range(200)]
    want = sorted(data, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    df = spark.createDataFrame(data, "id int, score double").repartition(5)
    write_ranked(df, ORDER, folder, 30)
    got = [tuple(r) for n in range(1, 11) for r in paging.indexed_page(spark, folder, ORDER, n).collect()]
    assert got == want
    write_ranked(df.limit(0), ORDER, f"{folder}/none")
    assert paging.indexed_page(spark, f"{folder}/none", ORDER, 3).collect() == []


def test_genre_postings_find_what_the_movies_hold(spark, folder):
    names = ["Drama", "Dramedy|Sci-Fi", "", None, "Film-Noir|Drama", "100%|a_b", "İstanbul|Größe"]
    movies = spark.createDataFrame([(i, g) for i, g in enumerate(names)] + [(None, "Drama")], "movie_id int, genres string")
    write_genre_postings(movies, folder)
    for needle in ("dram", "DRAMA", "a", "sci-fi", "i|D", "noir|d", "", "%", "_", "größe", "zzz", "|"):
        found = {r.movie_id for r in serving.movies_of_genre(movies, folder, needle).collect()} - {None}
        assert found == {r.movie_id for r in serving.genre_filter(movies, needle).collect()} - {None}, needle


def test_a_refresh_that_fails_leaves_the_tables_before_it(spark, tables, folder, monkeypatch):
    movies, _ = tables
    top = movies.selectExpr("movie_id AS movieId", "avg_rating AS weighted_rating", "avg_rating")
    first = sink.refresh_serving(movies, top, folder)
    before = [rows(t) for t in first]
    write, calls = sink.write_table_folder, []

    def failing(df, path, *more):
        calls.append(path)
        if len(calls) == 2:
            raise OSError("disk full")
        write(df, path, *more)

    monkeypatch.setattr(sink, "write_table_folder", failing)
    with pytest.raises(OSError):
        sink.refresh_serving(movies.where("movie_id > 1"), top, folder)
    assert len(calls) == 2 and [rows(t) for t in sink.read_serving(spark, folder)] == before
    monkeypatch.setattr(sink, "write_table_folder", write)
    after = sink.refresh_serving(movies.where("movie_id > 1"), top, folder)
    assert [len(rows(t)) for t in after] == [2, 2] and [len(rows(t)) for t in sink.read_serving(spark, folder)] == [2, 2]
    # Readers of the version before still have it, until it is removed.
    assert [rows(t) for t in first] == before
    sink.refresh_serving(movies, top, folder)
    assert versions.remove_old(spark, folder, keep=2) == [1]
    assert len([p for p in os.listdir(folder) if p.startswith("version-")]) == 2
    assert [rows(t) for t in sink.read_serving(spark, folder)] == before


def test_records_are_whole_and_written_once(spark, folder):
    with pytest.raises(FileNotFoundError):
        versions.current(spark, folder)
    assert versions.commit(spark, folder, f"{folder}/version-a", ["t", "u"]) == 1
    with pytest.raises(versions.ConcurrentCommit):
        versions.commit_paths(spark, folder, {"t": "x"}, after=0)
    assert versions.commit(spark, folder, f"{folder}/version-b", ["t", "u"]) == 2
    os.makedirs(f"{folder}/{versions.RECORDS}", exist_ok=True)
    with open(f"{folder}/{versions.RECORDS}/3.json", "w"):
        pass
    assert versions.current(spark, folder) == {"t": f"{folder}/version-b/t", "u": f"{folder}/version-b/u"}


@pytest.fixture(scope="module")
def tables(spark):
    movies = spark.createDataFrame(
        [(1, "a", "Drama|Comedy", 1990, 4.126, 10), (2, "b", "", None, 3.0, 5), (3, "c", None, 2000, 3.0, 7)],
        "movie_id int, title string, genres string, year int, avg_rating double, rating_count int",
    )
    recs = spark.createDataFrame(
        [(1, 1, 4.0), (2, 1, 4.5), (9, 1, 5.0), (1, 2, 4.567), (3, 2, 4.0), (2, 2, 4.0)],
        "movie_id int, user_id int, recommendation_score double",
    )
    return movies, recs


def test_user_top_n(tables):
    movies, recs = tables
    top = [(r.movie_id, r.predicted_rating, r.avg_rating) for r in serving.user_top_n(recs, movies, 2, 2).collect()]
    assert top == [(1, 4.57, 4.13), (2, 4.0, 3.0)]
    assert [r.movie_id for r in serving.user_top_n(recs, movies, 1).collect()] == [2, 1]
    assert serving.user_top_n(recs, movies, 77).count() == 0


def test_default_orders(tables):
    movies, recs = tables
    assert [r.movie_id for r in serving.movies_in_order(movies).collect()] == [1, 3, 2]
    assert [(r.movie_id, r.user_id) for r in serving.recommendations_in_order(recs).collect()] == [
        (9, 1),
        (1, 2),
        (2, 1),
        (1, 1),
        (2, 2),
        (3, 2),
    ]
    assert {r.movie_id for r in serving.dashboard_top(recs, movies, 2).collect()} == {1}


def test_genre_page(tables):
    movies, recs = tables
    page = serving.recommendation_page(recs, movies, 1, genre="COMEDY")
    assert rows(page, "movie_id", "user_id") == [(1, 1), (1, 2)]
    assert serving.genre_filter(movies, "").count() == 3


def test_distinct_genres(tables):
    assert [r.genre for r in serving.distinct_genres(tables[0]).collect()] == ["Comedy", "Drama"]


def test_totals(spark, tables):
    movies, recs = tables
    files = spark.createDataFrame([("a", True), ("b", False), ("c", None)], "data_file string, processed boolean")
    got = serving.dashboard_totals(movies, recs, files).first()
    assert tuple(got)[:4] == (3, 6, 3, 1) and got.avg_rating == pytest.approx(10.126 / 3)
    none = serving.dashboard_totals(movies.limit(0), recs.limit(0), files.limit(0)).first()
    assert tuple(none) == (0, 0, 0, 0, 0.0)
    assert tuple(serving.import_statistics(movies, recs).first()) == (3, 6, 2, 3.0)
    assert tuple(serving.import_statistics(movies, recs.limit(0)).first()) == (3, 0, 0, 0.0)


def test_import_keeps_known_movies_only(spark, tables):
    movies = serving.imported_movies(tables[0].withColumnRenamed("movie_id", "movieId"))
    assert rows(movies, "genres") == [("",), ("",), ("Drama|Comedy",)]
    twice = tables[0].unionByName(tables[0]).withColumnRenamed("movie_id", "movieId")
    assert serving.imported_movies(twice).count() == 3
    recs = spark.createDataFrame([(5, 1, 4.5), (5, 99, 5.0)], "userId int, movieId int, predicted_rating float")
    got = serving.imported_recommendations(recs, movies)
    assert rows(got, "movie_id", "user_id", "recommendation_score", "popularity_score") == [(1, 5, 4.5, 4.126)]


def test_frames_for_serving(spark):
    movies = spark.createDataFrame([(1, "a", "g", 1990), (2, "b", "g", None)], "movieId int, title string, genres string, year int")
    stats = spark.createDataFrame([(1, 3.5, 2)], "movieId int, avg_rating double, rating_count long")
    top = movies.join(stats, "movieId").withColumn("weighted_rating", F.lit(3.3))
    movie_frame, top_frame = serving.prepare_serving_frames(movies, stats, top)
    assert dict(movie_frame.dtypes)["avg_rating"] == "float" and dict(movie_frame.dtypes)["rating_count"] == "int"
    assert rows(movie_frame, "movie_id", "avg_rating", "rating_count") == [(1, 3.5, 2), (2, 0.0, 0)]
    assert rows(top_frame) == [(1, 3.3, 3.5)]


def test_display_and_preview(spark, tables):
    shown = serving.display_top(tables[0])
    assert rows(shown, "movie_id", "year", "avg_rating")[:2] == [(1, "1990", 4.13), (2, "N/A", 3.0)]
    recs = spark.createDataFrame([(1, 5, 3.0), (1, 6, 4.0), (2, 5, 5.0), (9, 5, 1.0)], "userId int, movieId int, predicted_rating float")
    assert [(r.userId, r.movieId) for r in serving.users_preview(recs, [1, 2]).collect()] == [(1, 6), (1, 5), (2, 5)]
