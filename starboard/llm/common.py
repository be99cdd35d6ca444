"""What several operators share: written steps, row keys, row order, exact integer names."""

from __future__ import annotations

import functools
import io
import os
import zipfile
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starboard.session import new_folder

# The white space of the contracts, space and the controls 9 to 13.
WHITE_SPACE = r"[\x20\x09-\x0D]"
LONG_MAX = 9_223_372_036_854_775_807


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read back: later steps do not repeat what made them."""
    path = new_folder(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def with_row_key(docs: DataFrame) -> tuple[DataFrame, str]:
    """Rows with a key of their own and its name, so that repeated or null ids do no harm.

    The key is the same each time the rows are read, whatever executors there are: for rows of Parquet files a
    row's place in its file, with 96 bits of hash for the file; other rows are stored with a number first.
    """
    key = free_name(docs, "_row")
    path = F.col("_metadata.file_path")
    place = F.struct(F.xxhash64(path).alias("file"), F.hash(path).alias("more"), F.col("_metadata.row_index").alias("row"))
    hidden = docs._jdf.queryExecution().analyzed().metadataOutput()
    if any(hidden.apply(i).name() == "_metadata" for i in range(hidden.size())):
        return docs.withColumn(key, place), key
    return stored(docs.withColumn(key, F.monotonically_increasing_id()), "keyed"), key


def in_order_of(docs: DataFrame, row: str, places: DataFrame, by: Sequence[str]) -> tuple[DataFrame, str]:
    """``docs`` with their number (from 0) in the order ``by`` of ``places``, and its column's name.

    ``places`` has the key ``row`` (see ``with_row_key``) and the columns of the order, which tell all rows apart. If the rows
    were written in that order, as each file shows by itself, a file's start and a row's place in it give the number, and
    no row moves; else the rows are brought into the order. Either way the rows of a task that follow each other in the
    order stand next to each other.
    """
    at, carry = free_name(docs, "_at"), [row, *by]
    numbers = stored(integer_names(places.select(*carry), list(by), carry, by[-1], at), "numbers")
    if isinstance(docs.schema[row].dataType, T.StructType):
        ahead = F.col(at) - F.col(f"{row}.row")
        files = numbers.groupBy(F.col(f"{row}.file").alias("_file"), F.col(f"{row}.more").alias("_more"))
        files = stored(files.agg(F.min(ahead).alias("_start"), F.max(ahead).alias("_end")), "files")
        if files.where("_start <> _end").isEmpty():
            # One row of 20 bytes for each file.
            same = (F.col(f"{row}.file") == F.col("_file")) & (F.col(f"{row}.more") == F.col("_more"))
            found = docs.join(F.broadcast(files.drop("_end")), same)
            return found.withColumn(at, F.col("_start") + F.col(f"{row}.row")).select(*docs.columns, at), at
    found = docs.join(numbers.select(row, at), row)
    return found.repartitionByRange(at).sortWithinPartitions(at).select(*docs.columns, at), at


def rank_of(columns: Sequence[str], row: str) -> Column:
    """A struct that sorts by the columns, nulls last, then by row."""
    parts = [p for c in columns for p in (F.col(c).isNull().alias(f"{c}_null"), F.col(c).alias(c))]
    return F.struct(*parts, F.col(row).alias(row))


# What a task remembers of words: so many bytes in all, and only words up to so many bytes.
REMEMBERED_BYTES = 64 << 20
LONGEST_REMEMBERED = 64
# What an entry takes besides its word and its result.
ENTRY_BYTES = 130


class Remembered(dict):
    """What ``find`` gives for words, remembered for short ones in ``most`` bytes.

    When half of that is full, words that came since the last time are kept for as long again, so that frequent
    ones stay. Long words (whole texts where a script has no spaces) are found each time they come.
    """

    def __init__(self, find: Callable, size: Callable = len, most: int = REMEMBERED_BYTES):
        super().__init__()
        self.find, self.size, self.most, self.held = find, size, most, 0
        self.before: dict = {}

    def __missing__(self, word):
        found = self.before.get(word)
        if found is None:
            found = self.find(word)
        if len(word) <= LONGEST_REMEMBERED:
            self.held += len(word) + self.size(found) + ENTRY_BYTES
            if self.held > self.most // 2:
                self.before, self.held = dict(self), 0
                self.clear()
            self[word] = found
        return found


CODE = "starboard_tasks.zip"


def _package_zip() -> bytes:
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for folder, _, files in os.walk(package):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(package)))
    return out.getvalue()


# Whole texts go to Python, so that a batch of rows is to be smaller than for numbers.
BATCH_ROWS = 1000


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors once, for functions that run in Python there, and keep batches small.

    It goes through the shared folder.
    """
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(batch)) > BATCH_ROWS:
        spark.conf.set(batch, BATCH_ROWS)
    context = spark.sparkContext
    if any(name.endswith(CODE) for name in context.listFiles):
        return
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{new_folder(spark, 'llm-code')}/{CODE}")
    stream = place.getFileSystem(context._jsc.hadoopConfiguration()).create(place)
    stream.write(_package_zip())
    stream.close()
    context.addPyFile(place.toString())


def _differs(column: pa.Array) -> pa.Array:
    """For each value but the first: whether it is not the one before; nulls are alike."""
    here, before = column.slice(1), column.slice(0, len(column) - 1)
    return pc.or_(pc.xor(pc.is_null(here), pc.is_null(before)), pc.fill_null(pc.not_equal(here, before), False))


def integer_names(
    rows: DataFrame, keys: Sequence[str], carry: Sequence[str], row: str, name: str, long_keys: bool = False
) -> DataFrame:
    """``carry`` and ``name``: an integer that two rows share exactly if their keys are equal.

    All rows are sorted by (keys, row) over all partitions, so that a key with many rows spans several of them.
    Each task numbers the runs of equal keys it sees; one row for each task, with its first and last key, tells
    where a run goes on in the next task and how far the numbers are shifted. Names start at 0, in key order.

    ``long_keys`` are sorted by a 64-bit hash first, so that the driver sees hashes, not keys, when Spark samples
    the ranges; keys with one hash are told apart by themselves. Only if their hash goes
    on from one task to the next, a key may be torn apart; that shows at the edges, and the hash is changed.
    """
    if not long_keys:
        return _numbered(rows, keys, carry, row, name, [])[0]
    for seed in range(8):
        hashed = rows.withColumn("_hash", F.xxhash64(F.lit(seed), *keys))
        named, torn = _numbered(hashed, keys, carry, row, name, ["_hash"])
        if not torn:
            return named
    raise RuntimeError("keys with equal hashes at the edges of tasks, for each of eight hashes")


def _numbered(
    rows: DataFrame, keys: Sequence[str], carry: Sequence[str], row: str, name: str, before: list[str]
) -> tuple[DataFrame, bool]:
    """The named rows, and whether a value of ``before`` goes on beyond an edge with another key.

    The ranges are those of ``before``.
    """
    source = rows.select(*dict.fromkeys([*before, *keys, *carry]))
    ends = [row] if row not in keys else []
    sorted_rows = source.repartitionByRange(*(before or keys), *ends).sortWithinPartitions(*before, *keys, *ends)
    shown = [*before, *keys]
    types = {f.name: f.dataType for f in source.schema}
    schema = T.StructType(
        [T.StructField(c, types[c]) for c in carry]
        + [T.StructField(c, T.LongType()) for c in ("_part", "_local", "_distinct")]
        + [T.StructField(f"_{edge}_{k}", types[k]) for edge in ("first", "last") for k in shown]
    )

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, local, first, last, arrow = TaskContext.get().partitionId(), -1, None, None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            columns = {k: batch.column(k) for k in shown}
            ends = [(columns[k][0].as_py(), columns[k][n - 1].as_py()) for k in shown]
            new = pa.array([first is None or [e[0] for e in ends] != last])
            if n > 1:
                rest = functools.reduce(pc.or_, (_differs(c) for c in columns.values()))
                new = pa.concat_arrays([new, rest])
            numbers = pc.add(pc.cumulative_sum(new.cast(pa.int64())), local)
            local = numbers[n - 1].as_py()
            first = first or [e[0] for e in ends]
            last = [e[1] for e in ends]
            out = {c: batch.column(c) for c in carry}
            out |= {"_part": pa.array([part] * n, pa.int64()), "_local": numbers, "_distinct": pa.nulls(n, pa.int64())}
            out |= {f"_{edge}_{k}": pa.nulls(n, columns[k].type) for edge in ("first", "last") for k in shown}
            made = pa.RecordBatch.from_pydict(out)
            arrow = made.schema
            yield made
        if first is not None:
            edges = dict.fromkeys(carry) | {"_part": part, "_local": None, "_distinct": local + 1}
            edges |= {f"_first_{k}": v for k, v in zip(shown, first)} | {f"_last_{k}": v for k, v in zip(shown, last)}
            yield pa.RecordBatch.from_pylist([edges], schema=arrow)

    ship_code(rows.sparkSession)
    found = stored(sorted_rows.mapInArrow(numbered, schema), "names")
    by_part = Window.orderBy("_part")
    follows = F.lag("_part").over(by_part).isNotNull()

    def alike(columns: Sequence[str]) -> Column:
        same = (F.col(f"_first_{k}").eqNullSafe(F.lag(f"_last_{k}").over(by_part)) for k in columns)
        return functools.reduce(lambda a, b: a & b, same) & follows

    edges = found.where(F.col("_distinct").isNotNull())
    tasks = edges.select("_part", "_distinct", F.when(alike(shown), 1).otherwise(0).alias("_same"))
    torn = False
    if before:
        # Within a task a hash's keys are in order. A key torn apart leaves an edge where the hash goes on, but not the key.
        torn = not edges.select((alike(before) & ~alike(keys)).alias("split")).where("split").isEmpty()
    shifts = tasks.select(
        "_part", (F.sum(F.col("_distinct") - F.col("_same")).over(by_part) - F.col("_distinct")).alias("_shift")
    )
    # One row for each task of the sort, whatever the size of the data: small enough for every executor.
    named = (
        found.where(F.col("_distinct").isNull())
        .join(F.broadcast(shifts), "_part")
        .select(*carry, (F.col("_local") + F.col("_shift")).alias(name))
    )
    return named, torn
