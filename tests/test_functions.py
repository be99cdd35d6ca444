import pytest
from conftest import rows
from pyspark.sql import functions as F

from starboard.functions import scores, text, time, validity


@pytest.mark.parametrize(
    "title, anywhere, anchored",
    [
        ("American President, The (1995)", 1995, 1995),
        ("Blade (1982) x (2049)", 1982, 2049),
        ("A (1995) ", 1995, None),
        ("Abc", None, None),
        ("Year (95)", None, None),
        ("(19955)", None, None),
        ("", None, None),
        (None, None, None),
    ],
)
def test_year(spark, title, anywhere, anchored):
    df = spark.createDataFrame([(title,)], "title string")
    got = df.select(text.year_anywhere(F.col("title")), text.year_anchored(F.col("title"))).first()
    assert tuple(got) == (anywhere, anchored)


def test_lacks_year_suffix(spark):
    df = spark.createDataFrame([("A (1995)",), ("A",), (None,)], "t string")
    assert [r[0] for r in df.select(text.lacks_year_suffix(F.col("t"))).collect()] == [False, True, None]


def test_split_genres_of_null_and_empty(spark):
    df = spark.createDataFrame([("a|b",), ("",), (None,)], "g string")
    assert [r[0] for r in df.select(text.split_genres(F.col("g"))).collect()] == [["a", "b"], [""], None]


def test_genre_match_takes_wildcards_literally(spark):
    df = spark.createDataFrame([("Sci-Fi",), ("50%",), ("a_b",), ("axb",), (None,)], "g string")
    found = lambda needle: [r[0] for r in df.where(text.genre_matches(F.col("g"), needle)).collect()]
    assert found("sci-fi") == ["Sci-Fi"]
    assert found("%") == ["50%"]
    assert found("A_B") == ["a_b"]


@pytest.mark.parametrize("zone", ["UTC", "Asia/Shanghai", "America/New_York"])
def test_dates_are_utc_in_any_session_zone(spark, zone):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(1420070399,), (1420070400,), (-1,), (None,)], "s long")
        s = F.col("s")
        got = [tuple(r) for r in df.select(time.rating_date(s), time.rating_year(s), time.rating_month(s)).collect()]
        back = [r[0] for r in df.select(time.utc_seconds(time.utc_timestamp(s))).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert got == [
        ("2014-12-31 23:59:59", 2014, 12),
        ("2015-01-01 00:00:00", 2015, 1),
        ("1969-12-31 23:59:59", 1969, 12),
        (None, None, None),
    ]
    assert back == [1420070399, 1420070400, -1, None]


def test_movie_validity_is_never_null(spark):
    data = [(1, "A", "G"), (None, "A", "G"), (1, None, "G"), (1, "", "G"), (1, "A", None), (1, "A", "")]
    data += [(1, "A", "(no genres listed)")]
    df = spark.createDataFrame(data, "i int, t string, g string")
    got = [r[0] for r in df.select(validity.movie_is_valid(F.col("i"), F.col("t"), F.col("g"))).collect()]
    assert got == [True] + [False] * 6


def test_rating_validity_and_range(spark):
    data = [(0.0,), (0.5,), (5.0,), (5.5,), (None,)]
    df = spark.createDataFrame(data, "r double")
    r = F.col("r")
    valid = [x[0] for x in df.select(validity.rating_is_valid(F.lit(1), F.lit(1), r, F.lit(1))).collect()]
    out = [x[0] for x in df.select(validity.rating_out_of_range(r)).collect()]
    assert valid == [False, True, True, False, False]
    assert out == [True, False, False, True, None]


def test_scores(spark):
    df = spark.createDataFrame([(4.0, 300), (2.0, 100)], "a double, n long")
    a, n = F.col("a"), F.col("n")
    got = rows(df.select("n", scores.bayesian_score(a, n, 100, F.lit(3.0)), scores.log_blend_score(a, n)))
    import math

    assert got[0][1] == pytest.approx(0.5 * 2 + 0.5 * 3)
    assert got[1][1] == pytest.approx(0.75 * 4 + 0.25 * 3)
    assert got[1][2] == pytest.approx(0.7 * 4 + 0.3 * math.log(301))
