"""A table of cleaned ratings that takes increments: pairs move between months, statistics follow.

The current version (see ``versions``) names a folder for each month, and the deltas of two narrow tables: the pairs, each
with the month, time and rating of its latest row, and sums for each item. An increment is compared with the pairs alone. It
reads and writes anew the months that win or lose a row; all others stay the folders they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starboard.operators.cleaning import clean_ratings, derived_columns
from starboard.schemas import CLEANED_RATINGS, RATING_PARTITIONS
from starboard.session import stored
from starboard.sinks.files import write_partitioned
from starboard.sinks.versions import commit_paths, latest, new_version

PAIR = ["userId", "movieId"]
PAIRS = "userId int, movieId int, rating double, timestamp long, rating_year int, rating_month int, batch long"
STATS = "movieId int, n long, total decimal(28,9)"
# Deltas that a reader puts together before they are written as one.
MOST_DELTAS = 8


def _months(tables: dict[str, str]) -> dict[tuple[int, int], str]:
    found = {}
    for name, path in tables.items():
        if name.startswith("month-"):
            _, year, month = name.split("-")
            found[int(year), int(month)] = path
    return found


def _deltas(spark: SparkSession, tables: dict[str, str], name: str, schema: str) -> DataFrame:
    paths = [path for key, path in sorted(tables.items()) if key.startswith(f"{name}-")]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _latest_pairs(pairs: DataFrame) -> DataFrame:
    """One row for each pair: that of the last batch that changed it."""
    state = F.struct("batch", "rating", "timestamp", "rating_year", "rating_month")
    return pairs.groupBy(*PAIR).agg(F.max(state).alias("s")).select(*PAIR, "s.*")


def _summed(stats: DataFrame) -> DataFrame:
    return stats.groupBy("movieId").agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(28,9)").alias("total"))


def read_increments(spark: SparkSession, folder: str, months: list[tuple[int, int]] | None = None) -> DataFrame:
    """The current ratings, of the given (year, month) only if there are some."""
    of_month = _months(latest(spark, folder)[1])
    paths = [path for month, path in sorted(of_month.items()) if months is None or month in months]
    return spark.read.schema(CLEANED_RATINGS).parquet(*paths) if paths else spark.createDataFrame([], CLEANED_RATINGS)


def current_item_stats(spark: SparkSession, folder: str) -> DataFrame:
    """``item_stats`` of the current ratings, from the sums alone; averages are exact to nine decimals of each rating."""
    sums = _summed(_deltas(spark, latest(spark, folder)[1], "stats", STATS)).where("n > 0")
    average = F.col("total").cast("double") / F.col("n")
    return sums.select("movieId", average.alias("avg_rating"), F.col("n").alias("rating_count"))


def upsert_ratings(spark: SparkSession, folder: str, raw: DataFrame, most_deltas: int = MOST_DELTAS) -> list[tuple[int, int]]:
    """Merge raw ratings into the table; return the months that were written anew or emptied.

    Of a pair's ratings the latest counts, of equally late ones the highest, whatever increment brought them and however
    often; the result is ``clean_ratings`` of all increments together. Another upsert that commits in between is an error.
    """
    number, tables = latest(spark, folder, missing_ok=True)
    version, batch = new_version(spark, folder), number + 1
    # Narrow rows until they are written: what follows from them is computed then.
    derived = derived_columns()
    fresh = stored(clean_ratings(raw).drop(*derived), "increment")
    asked = fresh.select(*PAIR)
    known = _latest_pairs(_deltas(spark, tables, "pairs", PAIRS).join(asked, PAIR, "left_semi"))
    old = known.select(*PAIR, *(F.col(c).alias(f"old_{c}") for c in ("rating", "timestamp", *RATING_PARTITIONS)))
    later = F.struct(F.col("timestamp"), F.col("rating")) > F.struct(F.col("old_timestamp"), F.col("old_rating"))
    if any(key.startswith("pairs-") for key in tables):
        won = stored(fresh.join(old, PAIR, "left").where(F.col("old_timestamp").isNull() | later), "winners")
    else:
        # Without known pairs all rows win, and they are stored already.
        won = fresh.select("*", *(F.lit(None).cast(old.schema[c].dataType).alias(c) for c in old.columns if c not in PAIR))
    replaced = won.where("old_timestamp IS NOT NULL")

    places = won.select(*RATING_PARTITIONS).unionByName(replaced.select(*(F.col(f"old_{c}").alias(c) for c in RATING_PARTITIONS)))
    touched = sorted((r[0], r[1]) for r in places.distinct().collect())
    if not touched:
        return []
    of_month = _months(tables)
    stay = [of_month[m] for m in touched if m in of_month]
    narrow = [c for c in CLEANED_RATINGS.names if c not in derived]
    rows = won.select(*narrow)
    if stay:
        before = spark.read.schema(CLEANED_RATINGS).parquet(*stay).select(*narrow)
        rows = before.join(replaced.select(*PAIR), PAIR, "left_anti").select(*narrow).unionByName(rows)
    rows = rows.withColumns(derived).select(*CLEANED_RATINGS.names)
    # The folders' names hold copies, so that the files have all columns and can be read one by one.
    copies = {f"_{c}": F.col(c) for c in RATING_PARTITIONS}
    write_partitioned(rows.withColumns(copies), f"{version}/months", list(copies), whole_table=True, derived=derived)
    written = spark.read.parquet(f"{version}/months").select(*copies).distinct().collect()

    tables = {k: v for k, v in tables.items() if not k.startswith("month-") or k not in {_name(*m) for m in touched}}
    tables |= {_name(y, m): f"{version}/months/_rating_year={y}/_rating_month={m}" for y, m in written}
    pairs = won.select(*PAIR, "rating", "timestamp", *RATING_PARTITIONS, F.lit(batch).cast("long").alias("batch"))
    change = F.col("rating").cast("decimal(18,9)") - F.coalesce(F.col("old_rating"), F.lit(0.0)).cast("decimal(18,9)")
    added = F.count_if(F.col("old_timestamp").isNull())
    sums = won.groupBy("movieId").agg(added.alias("n"), F.sum(change).cast("decimal(28,9)").alias("total"))
    for name, delta, schema, merge in (("pairs", pairs, PAIRS, _latest_pairs), ("stats", sums, STATS, _summed)):
        keys = [k for k in tables if k.startswith(f"{name}-")]
        if len(keys) >= most_deltas:
            delta = merge(_deltas(spark, tables, name, schema).unionByName(delta))
            tables = {k: v for k, v in tables.items() if k not in keys}
        columns = [c.split()[0] for c in schema.split(", ")]
        delta.select(*columns).write.parquet(f"{version}/{name}")
        tables[f"{name}-{batch:09}"] = f"{version}/{name}"
    commit_paths(spark, folder, tables, after=number)
    return touched


def _name(year: int, month: int) -> str:
    return f"month-{year}-{month}"


def upsert_all(spark: SparkSession, folder: str, increments: list[DataFrame]) -> list[tuple[int, int]]:
    """One increment after the other; all months that were touched."""
    return sorted(reduce(lambda seen, raw: seen | set(upsert_ratings(spark, folder, raw)), increments, set()))
