import pytest
from conftest import SMALL, final_plan, rows
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from starboard.operators import cleaning
from starboard.registry import inputs
from starboard.schemas import RAW_MOVIES, RAW_RATINGS
from starboard.session import build_session, new_folder, prepared, shared_folder
from starboard.sinks import files as sink_files
from starboard.sinks import jdbc as sink_jdbc
from starboard.sinks import serving as sink_serving
from starboard.sinks import tables
from starboard.sources import catalog, files, jdbc

MOVIES = [
    (11, "American President, The (1995)", "Comedy|Drama"),
    (12, " Quoted \"Name\" (1990) ", "Drama"),
    (13, "", None),
    (14, None, ""),
]


def text_file(folder, lines):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "part.csv").write_text("\n".join(lines) + "\n")
    return str(folder)


def test_read_movies_text(spark, tmp_path):
    lines = ["movieId,title,genres", '11,"American President, The (1995)",Comedy|Drama', "x,Bad (1990),Drama"]
    lines += ['12,"""Great"" Cats (1998)",', '13,"",Drama']
    got = rows(files.read_movies(spark, text_file(tmp_path / "m", lines)))
    assert got == [
        (None, "Bad (1990)", "Drama", 1990),
        (11, "American President, The (1995)", "Comedy|Drama", 1995),
        (12, '"Great" Cats (1998)', None, 1998),
        (13, "", "Drama", None),
    ]


def test_csv_round_trip_keeps_spaces_quotes_and_nulls(spark, folder):
    sink_files.write_csv(spark.createDataFrame(MOVIES, RAW_MOVIES), folder)
    assert rows(files.read_csv(spark, folder, RAW_MOVIES)) == sorted(MOVIES)


def test_inferred_types(spark, tmp_path):
    path = text_file(tmp_path / "r", ["userId,movieId,rating", "1,2,3.5", "2,3,"])
    assert files.read_csv(spark, path).dtypes == [("userId", "int"), ("movieId", "int"), ("rating", "double")]


def test_missing_file_raises(spark, tmp_path):
    with pytest.raises(AnalysisException):
        files.read_movies(spark, str(tmp_path / "none"))


def test_a_top_list_is_one_file(spark, folder):
    sink_files.write_csv(spark.range(5000).repartition(8).orderBy(F.desc("id")).limit(50), folder)
    assert len(spark.read.text(folder).inputFiles()) == 1


def test_user_range(spark, folder):
    sink_files.write_user_range(spark.range(100).withColumnRenamed("id", "userId"), folder, 10, 20)
    assert rows(spark.read.csv(folder, header=True, inferSchema=True)) == [(i,) for i in range(10, 21)]


@pytest.fixture(scope="module")
def months(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("months") / "ratings")
    sink_files.write_partitioned(inputs.cleaned_ratings(spark, SMALL), path)
    return path


def test_month_opens_its_partition_only(spark, months):
    month = files.read_month(spark, months, 1998, 1)
    plan = final_plan(month)
    filters = plan[plan.index("PartitionFilters") : plan.index("PushedFilters")]
    assert "(rating_year = 1998)" in filters and "(rating_month = 1)" in filters
    assert month.count() > 0
    assert {(r.rating_year, r.rating_month) for r in month.collect()} == {(1998, 1)}


def test_columns_and_filters_reach_the_scan(spark, months):
    plan = final_plan(files.read_cleaned_ratings(spark, months).groupBy("movieId").agg(F.avg("rating")))
    assert "PushedFilters: [IsNotNull(is_valid), EqualTo(is_valid,true)]" in plan
    assert "ReadSchema: struct<movieId:int,rating:double,is_valid:boolean>" in plan


def test_validity_reaches_the_scan(spark, months):
    plan = final_plan(cleaning.valid_ratings(spark.read.parquet(months)).groupBy("movieId").count())
    for pushed in ("IsNotNull(userId)", "IsNotNull(timestamp)", "GreaterThanOrEqual(rating,0.5)", "LessThanOrEqual(rating,5.0)"):
        assert pushed in plan


def test_a_users_rows_are_in_one_file(spark, folder):
    """And a user with a third of all rows is in several."""
    rest = spark.range(20000).select((F.col("id") % 2000).alias("user_id"), F.col("id").alias("movie_id"))
    hot = spark.range(10000).select(F.lit(777).cast("long").alias("user_id"), F.col("id").alias("movie_id"))
    score = (F.col("movie_id") % 10 / 2).alias("recommendation_score")
    recs = rest.union(hot).select("user_id", "movie_id", score).repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sink_serving.write_recommendations(recs, folder)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    placed = spark.read.parquet(folder).select("user_id", "_metadata.file_name")
    spread = placed.groupBy("user_id").agg(F.count_distinct("file_name").alias("files"))
    files_of = {r.user_id: r.files for r in spread.collect()}
    assert files_of.pop(777) > 1
    assert sum(n == 1 for n in files_of.values()) > 1980
    plan = final_plan(spark.read.parquet(folder).where("user_id = 5"))
    assert "EqualTo(user_id,5)" in plan


def test_partitions_are_replaced_not_added_to(spark, folder):
    first = cleaning.clean_ratings(spark.createDataFrame([(1, 1, 1.0, 0), (1, 2, 2.0, 5_000_000)], RAW_RATINGS))
    again = cleaning.clean_ratings(spark.createDataFrame([(1, 1, 5.0, 0)], RAW_RATINGS))
    for df in (first, first, again):
        sink_files.write_partitioned(df, folder)
    got = spark.read.parquet(folder)
    assert rows(got, "movieId", "rating", "rating_month") == [(1, 5.0, 1), (2, 2.0, 2)]


def test_a_large_month_is_written_by_several_tasks(spark, folder):
    """Rows of one month in one write task would be the whole month in one task."""
    rest = spark.range(6000).select(((F.col("id") % 20 + 1) * 2_700_000).alias("t"), "id")
    hot = spark.range(60000).select(F.lit(0).cast("long").alias("t"), (F.col("id") + 10000).alias("id"))
    raw = hot.union(rest).select(
        F.col("id").cast("int").alias("userId"), F.lit(1).alias("movieId"), F.lit(3.0).alias("rating"), F.col("t").alias("timestamp")
    )
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200KB")
    try:
        sink_files.write_partitioned(cleaning.clean_ratings(raw.repartition(8), dedup=False), folder)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    written = spark.read.parquet(folder)
    assert written.count() == 66000
    hot_files = [f for f in written.inputFiles() if "rating_year=1970/rating_month=1/" in f]
    assert len(hot_files) > 1


def test_orc_and_parquet_agree(spark, months, folder):
    sink_files.write_partitioned(spark.read.parquet(months), folder, format="orc")
    assert rows(files.read_cleaned_ratings(spark, folder, "orc")) == rows(files.read_cleaned_ratings(spark, months))


def test_parquet_tuning_reaches_the_file(spark, tmp_path):
    """Smaller row groups and pages show in the footers."""
    import pyarrow.parquet as pq

    ratings = inputs.cleaned_ratings(spark, SMALL).withColumn("rating_year", F.lit(2000)).withColumn("rating_month", F.lit(1))
    ratings = ratings.select("*", F.sha2(F.concat_ws(",", "userId", "movieId"), 512).alias("wide")).coalesce(1)
    groups = {}
    for name, size in (("tuned", sink_files.PARQUET_TUNING["parquet.block.size"]), ("small", "65536")):
        options = sink_files.PARQUET_TUNING | {"parquet.block.size": size}
        path = str(tmp_path / name)
        sink_files.write_partitioned(ratings, path, options=options)
        files_there = [f.removeprefix("file://") for f in spark.read.parquet(path).inputFiles()]
        groups[name] = max(pq.ParquetFile(f).metadata.num_row_groups for f in files_there)
    assert groups["tuned"] == 1 and groups["small"] > 1


def test_export_leaves_out_invalid_rows(spark, folder):
    cleaned = cleaning.clean_movies(spark.createDataFrame(MOVIES, RAW_MOVIES))
    sink_files.export_valid_csv(cleaned, folder, ["movieId", "title"])
    assert spark.read.csv(folder, header=True).count() == 2
    with pytest.raises(AnalysisException):
        sink_files.export_valid_csv(cleaned, folder, ["movieId", "genres_array"])


def test_tables_partitions_and_repair(spark, folder):
    tables.create_tables(spark, "shop", folder)
    assert "shop" in catalog.databases(spark)
    assert catalog.tables(spark, "shop") == sorted(tables.TABLES)
    assert spark.table("shop.cleaned_ratings").schema.simpleString() == tables.TABLES["cleaned_ratings"].simpleString()
    ratings = cleaning.clean_ratings(spark.createDataFrame([(1, 1, 1.0, 0), (1, 2, 2.0, 5_000_000)], RAW_RATINGS))
    tables.load_cleaned_ratings(spark, ratings, "shop", folder)
    assert rows(catalog.partitions(spark, "shop.cleaned_ratings")) == [
        ("rating_year=1970/rating_month=1",),
        ("rating_year=1970/rating_month=2",),
    ]
    report = catalog.verify_catalog(spark, "shop", ["cleaned_ratings", "other"])
    assert rows(report) == [
        ("database", "", 1.0, "PASS"),
        ("table", "cleaned_ratings", 1.0, "PASS"),
        ("table", "other", 0.0, "FAIL"),
    ]
    catalog.use_database(spark, "shop")
    try:
        assert spark.table("cleaned_ratings").count() == 2
    finally:
        catalog.use_database(spark, "default")
    missing = catalog.verify_catalog(spark, "nowhere", ["t"])
    assert rows(missing, "check", "status") == [("database", "FAIL"), ("table", "FAIL")]


def test_strip_qualifier(spark):
    df = spark.createDataFrame([(1, "a", 2)], "`t.id` int, `t.name` string, other int")
    assert catalog.strip_qualifier(df).columns == ["id", "name", "other"]


def test_refresh_replaces_both_tables(spark, folder):
    movies = spark.createDataFrame(
        [(1, "a", None, 1990, 3.0, 5)],
        "movie_id int, title string, genres string, year int, avg_rating float, rating_count int",
    )
    top = spark.createDataFrame([(1, 3.5, 3.0), (7, 4.0, 4.0)], "movieId int, weighted_rating double, avg_rating double")
    for _ in range(2):
        written, recs = sink_serving.refresh_serving(movies, top, folder)
    assert rows(written, "movie_id", "genres") == [(1, "")]
    assert rows(recs, "movie_id", "recommendation_score") == [(1, 3.5)]


def test_load_als_serving_counts_the_skipped(spark, folder):
    statistics = spark.createDataFrame([(1, "a", 1990, "g", 5, 3.0)], "movieId int, title string, year int, genres string, rating_count long, avg_rating double")
    recs = spark.createDataFrame([(4, 1, 4.0), (4, 2, 5.0), (5, 2, 5.0)], "userId int, movieId int, predicted_rating float")
    movies, loaded, skipped = sink_serving.load_als_serving(statistics, recs, folder)
    assert movies.count() == 1 and loaded.count() == 1 and skipped.first()[0] == 2


def test_jdbc_options():
    slices = jdbc.Slices("movieId", 1, 1000, 8)
    read = jdbc.jdbc_options("jdbc:x:y", jdbc.subquery("select 1"), {"driver": "d", "fetchsize": "5"}, slices)
    assert read == {
        "url": "jdbc:x:y",
        "dbtable": "(select 1) q",
        "driver": "d",
        "fetchsize": "5",
        "partitionColumn": "movieId",
        "lowerBound": "1",
        "upperBound": "1000",
        "numPartitions": "8",
    }
    write = sink_jdbc.write_options("jdbc:x:y", "movies", {"user": "u"}, 4)
    assert write == {
        "url": "jdbc:x:y",
        "dbtable": "movies",
        "user": "u",
        "batchsize": "10000",
        "numPartitions": "4",
        "truncate": "true",
    }


def test_jdbc_errors_are_raised(spark):
    """No driver for such an address: nothing is connected to, and nothing is swallowed."""
    with pytest.raises(Exception, match="driver"):
        jdbc.read_jdbc_table(spark, "jdbc:nothing://none", "t")
    with pytest.raises(Exception, match="driver"):
        sink_jdbc.write_jdbc(spark.range(1), "jdbc:nothing://none", "t")


def test_shared_folder_is_the_sessions(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert new_folder(spark, "a") != new_folder(spark, "a")
    assert build_session().conf.get("spark.sql.session.timeZone") == "UTC"


def test_shared_folder_without_setting_is_with_the_tables():
    class Fake:
        conf = {"spark.sql.warehouse.dir": "hdfs:///tables"}

    assert shared_folder(Fake()) == "hdfs:///tables/work"


def test_a_folder_of_the_driver_is_refused_on_a_cluster(spark, monkeypatch, folder):
    class Elsewhere:
        _jvm = spark._jvm

        class conf:
            get = staticmethod(lambda k, d=None: {"spark.sql.warehouse.dir": f"file:{folder}"}.get(k, d))

        class sparkContext:
            _jsc = spark.sparkContext._jsc
            master = "yarn"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Elsewhere())
    Elsewhere.sparkContext.master = "local[4]"
    assert shared_folder(Elsewhere()) == f"file:{folder}/work"


def test_prepared_anew_when_the_source_changes(spark, folder):
    spark.range(3).write.parquet(f"{folder}/source")
    made = []

    def write(path):
        made.append(path)
        spark.read.parquet(f"{folder}/source").write.parquet(path)

    first = prepared(spark, "copy", f"{folder}/source", write)
    assert prepared(spark, "copy", f"{folder}/source", write) == first
    spark.range(5).write.mode("append").parquet(f"{folder}/source")
    assert spark.read.parquet(prepared(spark, "copy", f"{folder}/source", write)).count() == 8 and len(made) == 2


def test_prepared_once_and_cleared(spark, monkeypatch):
    import os

    from starboard import session

    monkeypatch.setattr(session, "_made", {})
    monkeypatch.setattr(session, "_prepared", {})
    calls = []

    def write(folder):
        calls.append(folder)
        spark.range(3).write.parquet(f"{folder}/t")

    first = prepared(spark, "thing", "here", write)
    assert prepared(spark, "thing", "here", write) == first and calls == [first]
    assert prepared(spark, "thing", "there", write) != first
    database = f"{new_folder(spark, 'base')}"
    spark.sql(f"CREATE DATABASE to_go LOCATION '{database}'")
    spark.sql(f"CREATE TABLE to_go_too (id LONG) USING parquet LOCATION '{first}/t'")
    session.clear_work(spark)
    assert "to_go" not in catalog.databases(spark) and "to_go_too" not in catalog.tables(spark, "default")
    assert not os.path.exists(first) and not os.path.exists(database)
    assert prepared(spark, "thing", "here", write) != first
    session.clear_work(spark)


def test_derived_columns_are_computed_after_the_exchange(spark, tmp_path, monkeypatch):
    raw = spark.createDataFrame([(u, m, 0.5 + (u + m) % 10 / 2, 86_400 * 40 * m) for u in range(30) for m in range(20)], RAW_RATINGS)
    cleaned, seen = cleaning.clean_ratings(raw), []
    hint = type(cleaned).hint
    monkeypatch.setattr(type(cleaned), "hint", lambda df, *a: seen.append(df.columns) or hint(df, *a))
    sink_files.write_partitioned(cleaned, f"{tmp_path}/narrow", whole_table=True, derived=cleaning.derived_columns())
    sink_files.write_partitioned(cleaned, f"{tmp_path}/wide", whole_table=True)
    assert seen[0] == ["userId", "movieId", "rating", "timestamp", "rating_year", "rating_month"] and seen[1] == cleaned.columns
    tables = [spark.read.parquet(f"{tmp_path}/{name}") for name in ("narrow", "wide")]
    assert tables[0].schema == tables[1].schema and rows(tables[0]) == rows(tables[1])
