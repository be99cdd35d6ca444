"""Pages of an ordered list.

``page_after`` needs the last row of the page before and costs one top-k. ``indexed_page`` goes
to any page of a list that was written in order, and opens the files that hold it.
``numbered_page`` does so for any rows, as a filter leaves them: from counts of value ranges,
narrowed down to about one page, it finds the row the page starts with.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starboard.schemas import PAGE_SIZE

RANGES = 256


@dataclass(frozen=True)
class Order:
    """A numeric column and its direction. NULLs come last either way."""

    column: str
    descending: bool = False

    def value(self) -> Column:
        """A value that grows along the order, NULL for NULL."""
        return -F.col(self.column) if self.descending else F.col(self.column)

    def keys(self) -> list[Column]:
        """Values without NULLs that grow along the order."""
        return [F.col(self.column).isNull().cast("int"), F.coalesce(self.value(), F.lit(0))]

    def places(self, value) -> list:
        """The keys of a value."""
        return [1, 0] if value is None else [0, -value if self.descending else value]


def all_keys(order: list[Order]) -> list[Column]:
    return [key for o in order for key in o.keys()]


def _beyond(keys: list[Column], places: list, inclusive: bool) -> Column:
    """Rows that come after the row with these keys, or with it if ``inclusive``."""
    beyond = F.lit(inclusive)
    for key, place in reversed(list(zip(keys, places, strict=True))):
        beyond = (key > F.lit(place)) | ((key == F.lit(place)) & beyond)
    return beyond


def page_after(df: DataFrame, order: list[Order], last: list | None, size: int = PAGE_SIZE) -> DataFrame:
    """The ``size`` rows that follow the row whose order values are ``last`` (None: the first page)."""
    keys = all_keys(order)
    if last is not None:
        places = [p for o, value in zip(order, last, strict=True) for p in o.places(value)]
        df = df.where(_beyond(keys, places, inclusive=False))
    return df.orderBy(*keys).limit(size)


def clamp_page(page, rows: int, size: int = PAGE_SIZE) -> int:
    """The page to show: 1 for something that is no number, the last one for a number out of range."""
    last = max(1, math.ceil(rows / size))
    try:
        number = int(page)
    except (TypeError, ValueError):
        return 1
    return number if 1 <= number <= last else last


def _ranges(df: DataFrame, order: Order) -> tuple[Column, list[tuple[int, int]]]:
    """The number of a row's range of values, and the rows of each range, in order.

    Each cut is a range of its own (odd numbers), and so is what lies between two cuts (even
    ones). Cuts are values that occur, so every range is smaller than the whole or one value.
    NULLs are the last range.
    """
    steps, value = [i / RANGES for i in range(1, RANGES)], order.value()
    cuts = sorted(set(df.select(F.percentile_approx(value, steps)).first()[0] or []))
    number = F.lit(1)
    if cuts:
        values = F.array(*[F.lit(c) for c in cuts])
        below, up_to = F.filter(values, lambda c: c < value), F.filter(values, lambda c: c <= value)
        number = F.when(value.isNull(), 2 * len(cuts) + 1).otherwise(F.size(below) + F.size(up_to))
    return number, sorted(tuple(r) for r in df.groupBy(number.alias("n")).count().collect())


def numbered_page(df: DataFrame, order: list[Order], page, size: int = PAGE_SIZE) -> DataFrame:
    """Page ``page``, counted from 1, of ``df`` in ``order``, whose columns must identify a row.

    Column by column, ranges are narrowed until the one that holds the page's first row is no longer
    than a page or a single value. Only counts of ranges come to the driver; the first of them
    also give the number of pages.
    """
    keys, rows, left, offset = all_keys(order), df, None, 0
    for o in order:
        single = False
        while not single and (left is None or left > size):
            number, counts = _ranges(rows, o)
            if left is None:
                left = sum(count for _, count in counts)
                offset = (clamp_page(page, left, size) - 1) * size
            if not left:
                return df.limit(0)
            for n, left in counts:
                if offset < left:
                    break
                offset -= left
            rows, single = rows.where(number == n), n % 2 == 1
    first = rows.orderBy(*keys).offset(offset).limit(1).select(*keys).first()
    return df.where(_beyond(keys, list(first), inclusive=True)).orderBy(*keys).limit(size)


def indexed_page(spark: SparkSession, folder: str, order: list[Order], page, size: int = PAGE_SIZE) -> DataFrame:
    """Page ``page``, counted from 1, of a list written by ``write_ranked``: its files are opened, and no others.

    The index has a row for each file. Of these the driver sees how many rows there are, and those that the page is in.
    """
    index = spark.read.schema("file string, rows long, start long").parquet(f"{folder}/positions")
    total = index.agg(F.max(F.col("start") + F.col("rows"))).first()[0] or 0
    first = (clamp_page(page, total, size) - 1) * size
    held = index.where((F.col("start") < first + size) & (F.col("start") + F.col("rows") > first)).collect()
    if not held:
        return spark.read.parquet(f"{folder}/rows").limit(0)
    rows = spark.read.parquet(*(f"{folder}/rows/{r['file']}" for r in held))
    start = F.lit(None).cast("long")
    for r in held:
        start = F.when(F.col("_metadata.file_name") == r["file"], F.lit(r["start"])).otherwise(start)
    wanted = rows.where((start + F.col("_metadata.row_index")).between(first, first + size - 1))
    return wanted.orderBy(*all_keys(order))
