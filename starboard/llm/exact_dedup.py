"""Exact duplicates by deterministic naming of blocks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starboard.llm.common import integer_names, rank_of, ship_code, stored

BLOCK_BYTES = 4096


def normalised(text: str | None) -> bytes:
    """UTF-8 of the text with each run of white space (space and the controls 9 to 13) as one space; null as empty."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()  # ASCII white space only
    before = b" " if data[:1].isspace() else b""
    after = b" " if words and data[-1:].isspace() else b""
    return before + b" ".join(words) + after


def cut_blocks(docs: DataFrame, carry: Sequence[str], text: str, row: str, block_bytes: int) -> DataFrame:
    """A row for each block of a normalised text, at least one; ``carry`` and the text's sha256 are with the first."""
    picked = docs.select(row, *carry, text)
    kinds = {f.name: f.dataType for f in picked.schema}
    schema = T.StructType(
        [T.StructField(row, kinds[row]), *(T.StructField(c, kinds[c]) for c in carry)]
        + [T.StructField("text_sha256", T.StringType()), T.StructField("n_blocks", T.LongType())]
        + [T.StructField("_pos", T.LongType()), T.StructField("_block", T.BinaryType())]
    )
    n = 1 + len(carry)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, first, sums, sizes, places, blocks = [], [], [], [], [], []
            for i, value in enumerate(batch.column(n)):
                plain = normalised(value.as_py())
                own = [plain[p : p + block_bytes] for p in range(0, max(1, len(plain)), block_bytes)]
                at += [i] * len(own)
                first += [i, *[None] * (len(own) - 1)]
                sums += [hashlib.sha256(plain).hexdigest(), *[None] * (len(own) - 1)]
                sizes += [len(own)] * len(own)
                places += range(len(own))
                blocks += own
            columns = [batch.column(0).take(pa.array(at, pa.int64()))]
            columns += [batch.column(k).take(pa.array(first, pa.int64())) for k in range(1, n)]
            columns += [pa.array(sums, pa.string()), pa.array(sizes, pa.int64()), pa.array(places, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(blocks, pa.binary())], names=schema.names)

    ship_code(docs.sparkSession)
    return picked.mapInArrow(cut, schema)


def document_names(docs: DataFrame, carry: Sequence[str], text: str, row: str, block_bytes: int) -> DataFrame:
    """``row``, ``carry``, sha256 of the normalised text, number of blocks and the name of the whole text.

    Texts are cut into blocks of a fixed size. Sorting all blocks gives each an integer name; adjacent names are
    paired and the pairs sorted and named again, until one name is left for each text. Two texts with the same
    number of blocks are equal exactly if their last names are: nothing rests on a hash.
    """
    blocks = cut_blocks(docs, carry, text, row, block_bytes)
    kept = [row, "_pos", "n_blocks", *carry, "text_sha256"]
    named = integer_names(blocks, ["_block"], kept, row, "_name", long_keys=True)
    out, left, columns = None, F.col("n_blocks"), [row, *carry, "text_sha256", "n_blocks", F.col("_name").alias("name")]
    most = named.agg(F.max("n_blocks")).first()[0] or 1
    while True:
        done = named.where(left == 1).select(*columns)
        out = done if out is None else out.unionByName(done)
        if most == 1:
            return out
        pairs = named.where(left > 1).groupBy(row, F.expr("_pos div 2").alias("_pos")).agg(
            F.max(F.when(F.col("_pos") % 2 == 0, F.col("_name"))).alias("_left"),
            F.max(F.when(F.col("_pos") % 2 == 1, F.col("_name"))).alias("_right"),
            F.max("n_blocks").alias("n_blocks"),
            *(F.max(c).alias(c) for c in (*carry, "text_sha256")),
        )
        named = integer_names(pairs, ["_left", "_right"], kept, row, "_name")
        left, most = F.ceil(left / 2), -(-most // 2)


def exact_dedup(
    docs: DataFrame,
    *,
    order: Sequence[str] = ("doc_id",),
    text: str = "text",
    row: str | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """For each row of ``docs``: its group of equal normalised texts and the row that stays.

    Returns ``row``, the ``order`` columns, ``keep`` (a struct with the order columns of the row that stays),
    ``group_size``, ``kept``, ``text_sha256``. The first row by ``order`` stays, nulls last; of rows alike in
    these, one stays. Null text is empty, and empty texts are equal. ``row`` names a column that identifies a
    row each time it is read; without it one is made. Other columns are not read, whatever their names.
    """
    key = row or "_row"
    if row is None:
        docs = docs.select(*order, text).withColumn(key, F.monotonically_increasing_id())
    carry = [c for c in order if c != key]
    named = stored(document_names(docs, carry, text, key, block_bytes), "documents")
    named = named.withColumn("_rank", rank_of(order, key))
    groups = named.groupBy("n_blocks", "name").agg(F.min("_rank").alias("keep"), F.count(F.lit(1)).alias("group_size"))
    # Only texts that occur more than once are looked up; the rest stand for themselves.
    copied = stored(groups.where("group_size > 1"), "groups")
    joined = named.join(copied, ["n_blocks", "name"], "left")
    return joined.select(
        key,
        *carry,
        F.coalesce("keep", "_rank").alias("keep"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.coalesce("keep", "_rank")[key] == F.col(key)).alias("kept"),
        "text_sha256",
    )
