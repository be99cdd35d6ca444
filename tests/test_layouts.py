"""Stored layouts: month bitmaps, bucketed tables, footers."""

import random
import re

import pytest
from conftest import final_plan, rows
from pyspark.sql import functions as F

from starboard.operators import cleaning, joins, month_state, quality, stats
from starboard.schemas import RAW_RATINGS
from starboard.sinks.bucketed import distinct_pairs, write_bucketed
from starboard.sources.footers import footer_totals

MONTH = 30 * 86400


def ratings(spark, seed, months, n=3000):
    """Item 1 holds a third of the ratings; ids go over several bitmaps, below zero too."""
    dice = random.Random(seed)
    data = [
        (
            dice.choice([dice.randrange(300), 40_000 + dice.randrange(90), 32_768, 32_769, -5, 0]),
            1 if dice.random() < 0.33 else dice.randrange(2, 70_000, 1000),
            dice.randrange(1, 11) / 2,
            dice.choice(months) * MONTH + dice.randrange(1000),
        )
        for _ in range(n)
    ]
    return spark.createDataFrame(data, RAW_RATINGS)


def test_month_state_against_the_ratings(spark, folder):
    first, second = (cleaning.clean_ratings(ratings(spark, s, m), dedup=False) for s, m in ((1, [100, 101, 102]), (2, [102, 103])))
    month_state.write_month_state(first, folder, whole_table=True)
    replaced = second.select("rating_year", "rating_month").distinct()
    now = first.join(replaced, ["rating_year", "rating_month"], "left_anti").unionByName(second).cache()
    month_state.write_month_state(second, folder)
    shown = month_state.stored_ratings_by_month(spark, folder, 3)
    assert [tuple(r) for r in shown.collect()] == [
        pytest.approx(tuple(r)) for r in quality.ratings_by_month(now, 3).collect()
    ]
    totals, want = month_state.stored_totals(spark, folder), quality.verify_ratings(now)
    assert totals.columns == want.columns and dict(totals.dtypes) == dict(want.dtypes)
    assert tuple(totals.first())[1:] == pytest.approx(tuple(want.first())[1:])
    assert rows(month_state.distinct_in_months(spark, folder, "item")) == rows(
        now.groupBy("rating_year", "rating_month").agg(F.count_distinct("movieId"))
    )


def test_month_state_needs_no_distinct_and_no_expand(spark):
    cleaned = cleaning.clean_ratings(ratings(spark, 3, [100]), dedup=False)
    plan = final_plan(month_state.month_bitmaps(cleaned, "user"))
    assert "Expand" not in plan and "bitmap_construct_agg" in plan
    # One exchange, by month and bucket, of what each task has put together.
    assert len(re.findall(r"Exchange hashpartitioning", plan.split("Initial Plan")[0])) == 1


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("bucketed"))
    raw = ratings(spark, 4, [100, 101]).unionByName(spark.createDataFrame([(None, 1, 3.0, 5), (1, None, 3.0, 5)], RAW_RATINGS))
    movies = raw.select("movieId").distinct().where("movieId % 3 <> 0").withColumn("title", F.lit("t"))
    movies = movies.withColumns({"year": F.lit(1990), "genres": F.lit("g")})
    by_item = write_bucketed(raw, "by_item", f"{base}/by_item", ["movieId"], 8, ["movieId", "userId"])
    by_pair = write_bucketed(raw, "by_pair", f"{base}/by_pair", ["userId", "movieId"], 8, ["userId", "movieId"])
    known = write_bucketed(movies, "known", f"{base}/known", ["movieId"], 8, ["movieId"])
    yield raw, movies, by_item, by_pair, known
    for name in ("by_item", "by_pair", "known"):
        spark.sql(f"DROP TABLE {name}")


def exchanges(df):
    return re.findall(r"Exchange (?!SinglePartition)\w+", final_plan(df).split("Initial Plan")[0])


def test_pair_work_needs_no_exchange(spark, tables):
    raw, _, by_item, by_pair, _ = tables
    for table in (by_item, by_pair):
        latest = cleaning.dedup_latest(cleaning.valid_ratings(table))
        assert rows(latest) == rows(cleaning.dedup_latest(cleaning.valid_ratings(raw))) and exchanges(latest) == []
        pairs = distinct_pairs(table)
        assert rows(pairs) == rows(quality.pair_counts(raw)) and exchanges(pairs) == []


def test_item_work_and_joins_need_no_exchange(spark, tables):
    raw, movies, by_item, _, known = tables
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        found = joins.with_stats(known, stats.item_stats(by_item))
        assert exchanges(found) == []
        assert rows(found) == rows(joins.with_stats(movies, stats.item_stats(raw)))
    finally:
        spark.conf.set(key, before)


def test_the_bucket_of_a_hot_item(tables):
    """By item its bucket has a third of the rows and more; by pair no bucket has much above its share."""
    _, _, by_item, by_pair, _ = tables
    shares = []
    for table in (by_item, by_pair):
        sizes = [r["count"] for r in table.groupBy(F.col("_metadata.file_name")).count().collect()]
        shares.append(max(sizes) / sum(sizes))
    print(f"largest bucket by item {shares[0]:.0%}, by pair {shares[1]:.0%}")
    assert shares[0] > 0.33 and shares[1] < 0.3


def test_footers_answer_without_reading_rows(spark, folder):
    data = [(i if i % 5 else None, i, None if i % 7 == 0 else i / 2, i * 10) for i in range(1000)]
    spark.createDataFrame(data, RAW_RATINGS).repartition(3).write.parquet(folder)
    found = footer_totals(spark, folder, ["userId", "movieId", "rating"], ["rating", "timestamp"])
    assert tuple(found.first()) == (1000, 200, 0, 143, 0.5, 499.5, 0, 9990)
    plan = found._jdf.queryExecution().executedPlan().toString()
    pushed = re.search(r"PushedAggregation: \[([^\]]*)\]", plan)[1]
    assert all(f in pushed for f in ("COUNT(*)", "COUNT(userId)", "MIN(rating)", "MAX(timestamp)"))
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"


def test_footers_of_no_rows(spark, folder):
    spark.createDataFrame([], RAW_RATINGS).write.parquet(folder)
    assert tuple(footer_totals(spark, folder, ["userId"], ["rating"]).first()) == (0, 0, None, None)


def test_buckets_follow_the_rows(spark, tmp_path, monkeypatch):
    from starboard.sinks import bucketed

    assert bucketed.buckets_for(2_400_000) == 8 and bucketed.buckets_for(216_000_000) == 54
    monkeypatch.setattr(bucketed, "BUCKET_ROWS", 10)
    pairs = spark.range(200).select((F.col("id") % 50).cast("int").alias("userId"), (F.col("id") % 7).cast("int").alias("movieId"))
    table = write_bucketed(pairs, "by_rows", f"{tmp_path}/by_rows", ["userId", "movieId"], None)
    described = spark.sql("DESCRIBE TABLE EXTENDED by_rows").where("col_name = 'Num Buckets'").first()
    assert described["data_type"] == "20"
    assert distinct_pairs(table).first().asDict() == {"total": 200, "pairs": 200}


def test_month_bitmaps_bring_numbers_together(spark):
    """No bitmaps in the exchange: it holds numbers."""
    rated = spark.range(0, 100_000, 1, 8).select(
        (F.col("id") % 100).cast("int").alias("userId"), (F.col("id") % 2 + 2020).cast("int").alias("rating_year"), (F.col("id") % 2 + 1).cast("int").alias("rating_month")
    )
    bitmaps = month_state.month_bitmaps(rated, "user")
    found = bitmaps.select("bucket", F.bitmap_count("bitmap").alias("n")).collect()
    assert sorted((r.bucket, r.n) for r in found) == [(0, 1), (1, 49), (1, 50)]
    plan = bitmaps._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_COL" in plan
