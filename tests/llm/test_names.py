import random

import pytest
from pyspark.sql import functions as F

from starboard.llm.common import free_name, integer_names
from starboard.llm.components import connected_components


@pytest.mark.parametrize("hot", [0, 4000])
def test_names_follow_the_order_of_keys(spark, hot):
    dice = random.Random(5)
    keys = [dice.choice([None, "", "a", "b", *map(str, range(300))]) for _ in range(2000)] + ["hot"] * hot
    rows = spark.createDataFrame(list(enumerate(keys)), "r long, k string").repartition(7)
    got = {r["r"]: r["name"] for r in integer_names(rows, ["k"], ["r"], "r", "name").collect()}
    order = {k: i for i, k in enumerate(sorted(set(keys), key=lambda k: (k is not None, k)))}
    assert got == {i: order[k] for i, k in enumerate(keys)}


@pytest.mark.parametrize("hot", [0, 4000])
def test_long_keys_have_the_same_names_if_equal(spark, hot):
    dice = random.Random(6)
    keys = [dice.choice([None, "", *map(str, range(300))]) for _ in range(2000)] + ["hot"] * hot
    rows = spark.createDataFrame(list(enumerate(keys)), "r long, k string").repartition(7)
    named = integer_names(rows, ["k"], ["r"], "r", "name", long_keys=True).collect()
    pairs = {(keys[r["r"]], r["name"]) for r in named}
    assert len(named) == len(keys) and len(pairs) == len(set(keys)) == len({n for _, n in pairs})
    assert {n for _, n in pairs} == set(range(len(pairs)))


def test_equal_hashes_do_not_make_equal_names(spark, monkeypatch):
    """With a hash of 3 values most keys collide; where one is torn apart, another seed is tried."""
    real, seeds = F.xxhash64, []

    def poor(seed, *columns):
        seeds.append(seed)
        return real(seed, *columns) % 3 if len(seeds) < 3 else real(seed, *columns)

    keys = [str(i % 50) for i in range(3000)]
    rows = spark.createDataFrame(list(enumerate(keys)), "r long, k string").repartition(7)
    monkeypatch.setattr(F, "xxhash64", poor)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        named = integer_names(rows, ["k"], ["r"], "r", "name", long_keys=True).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(seeds) == 3 and len({(keys[r["r"]], r["name"]) for r in named}) == 50 == len({r["name"] for r in named})


def test_pairs_with_nulls_are_named(spark):
    pairs = [(1, 1, 2), (2, 1, None), (3, 1, 2), (4, 2, None), (5, 1, None), (6, 0, 9)]
    rows = spark.createDataFrame(pairs, "r long, a long, b long")
    got = {r["r"]: r["name"] for r in integer_names(rows, ["a", "b"], ["r"], "r", "name").collect()}
    assert got == {6: 0, 2: 1, 5: 1, 1: 2, 3: 2, 4: 3}


def test_no_rows_have_no_names(spark):
    rows = spark.createDataFrame([], "r long, k string")
    assert integer_names(rows, ["k"], ["r"], "r", "name").collect() == []


def test_free_name(spark):
    df = spark.createDataFrame([], "_ROW int, __row int")
    assert free_name(df, "_row") == "___row"


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, shape):
    dice = random.Random(3)
    links = {
        "chain": [(i, i + 1) for i in range(200)],
        "star": [(500, i) for i in range(200)] + [(900, 901), (901, None), (7, 7)],
        "random": [(dice.randrange(300), dice.randrange(300)) for _ in range(170)],
        "none": [],
    }[shape]
    parent = {n: n for link in links for n in link if n is not None}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    linked = {n for a, b in links if a is not None and b is not None and a != b for n in (a, b)}
    df = spark.createDataFrame(links, "a long, b long").withColumn("c", F.lit(1))
    got = {r["node"]: r["root"] for r in connected_components(df, "a", "b").collect()}
    assert got == {n: find(n) for n in linked}
