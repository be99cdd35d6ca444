"""Increments against cleaning all ratings together."""

import random

import pytest
from conftest import final_plan, rows
from pyspark.sql import functions as F

from starboard.operators.cleaning import clean_ratings
from starboard.operators.stats import item_stats
from starboard.schemas import RAW_RATINGS
from starboard.sinks import increments, versions

MONTH = 30 * 86400


def ratings(spark, dice, n, months, users=12, items=9):
    """Few pairs, so that most are rated in several increments; null and invalid rows among them."""
    data = [
        (
            dice.choice([None, *range(users)]),
            dice.randrange(items),
            dice.choice([None, 0.0, 0.5, 1.5, 3.0, 4.5, 5.0, 5.5]),
            dice.choice([None, *(dice.choice(months) * MONTH + dice.randrange(3) for _ in range(9))]),
        )
        for _ in range(n)
    ]
    return spark.createDataFrame(data, RAW_RATINGS)


@pytest.mark.parametrize("most_deltas", [1, 8])
def test_increments_are_cleaning_of_all_together(spark, folder, most_deltas):
    dice, seen = random.Random(most_deltas), None
    for months in ([100, 101, 102], [102], [50, 103], [100], [102, 103]):
        raw = ratings(spark, dice, 60, months)
        seen = raw if seen is None else seen.unionByName(raw)
        before = versions.latest(spark, folder, missing_ok=True)[1]
        touched = increments.upsert_ratings(spark, folder, raw, most_deltas)
        after = versions.latest(spark, folder)[1]
        want = clean_ratings(seen)
        assert rows(increments.read_increments(spark, folder)) == rows(want)
        stats = increments.current_item_stats(spark, folder)
        assert rows(stats.withColumn("avg_rating", F.round("avg_rating", 9))) == rows(
            item_stats(want).withColumn("avg_rating", F.round("avg_rating", 9))
        )
        names = {increments._name(*m) for m in touched}
        assert all(after[k] == v for k, v in before.items() if k.startswith("month-") and k not in names)
        assert {k for k in before if k.startswith("month-")} - set(after) <= names
        assert sum(k.startswith("pairs-") for k in after) <= most_deltas
    month = next(iter(increments._months(after)))
    some = increments.read_increments(spark, folder, [month])
    assert rows(some) == rows(want.where((F.col("rating_year") == month[0]) & (F.col("rating_month") == month[1])))


def test_statistics_do_not_read_ratings(spark, folder):
    increments.upsert_ratings(spark, folder, ratings(spark, random.Random(1), 80, [100, 101]))
    increments.upsert_ratings(spark, folder, ratings(spark, random.Random(2), 80, [101]))
    plan = final_plan(increments.current_item_stats(spark, folder))
    assert "/stats" in plan and "/months" not in plan and "/pairs" not in plan


def test_the_same_increment_twice_changes_nothing(spark, folder):
    raw = ratings(spark, random.Random(4), 80, [100, 101])
    assert increments.upsert_ratings(spark, folder, raw)
    before = versions.latest(spark, folder)
    assert increments.upsert_ratings(spark, folder, raw) == [] and versions.latest(spark, folder) == before
    assert increments.upsert_ratings(spark, folder, raw.limit(0)) == []


def test_a_month_that_loses_all_its_rows_goes(spark, folder):
    def one(seconds):
        return spark.createDataFrame([(1, 1, 3.0, seconds)], RAW_RATINGS)

    increments.upsert_ratings(spark, folder, one(100 * MONTH))
    assert len(increments.upsert_ratings(spark, folder, one(103 * MONTH))) == 2
    assert len(increments._months(versions.latest(spark, folder)[1])) == 1
    assert increments.read_increments(spark, folder).count() == 1
    versions.remove_old(spark, folder, keep=1)
    assert increments.read_increments(spark, folder).count() == 1


def test_two_writers_at_once(spark, folder, monkeypatch):
    raw = ratings(spark, random.Random(5), 40, [100])
    increments.upsert_ratings(spark, folder, raw)
    real = increments.commit_paths

    def late(*args, **more):
        monkeypatch.setattr(increments, "commit_paths", real)
        increments.upsert_ratings(spark, folder, ratings(spark, random.Random(6), 40, [102]))
        return real(*args, **more)

    monkeypatch.setattr(increments, "commit_paths", late)
    with pytest.raises(versions.ConcurrentCommit):
        increments.upsert_ratings(spark, folder, ratings(spark, random.Random(7), 40, [103]))


def test_increments_are_kept_narrow_until_they_are_written(spark, tmp_path, monkeypatch):
    """And the first is stored once, as all its rows win."""
    kept, stored = [], increments.stored
    monkeypatch.setattr(increments, "stored", lambda df, name: kept.append((name, df.columns)) or stored(df, name))
    raw = spark.createDataFrame([(u, m, 3.0, 86_400 * 40 * m) for u in range(9) for m in range(5)], RAW_RATINGS)
    later = raw.where("userId = 1").selectExpr("userId", "movieId", "rating", "timestamp + 86400 * 60 AS timestamp")
    increments.upsert_all(spark, str(tmp_path), [raw, later])
    assert [name for name, _ in kept] == ["increment", "increment", "winners"]
    assert not any("rating_date" in columns for _, columns in kept)
    want = clean_ratings(raw.unionByName(later))
    assert rows(increments.read_increments(spark, str(tmp_path)), *want.columns) == rows(want)
