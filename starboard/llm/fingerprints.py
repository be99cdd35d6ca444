"""Document fingerprints: every shingle hash below a fixed fraction of all hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starboard.llm.common import WHITE_SPACE, stored, with_row_key

WORDS = 5
# One of 2 ** 3 hashes is kept.
SCALE_BITS = 3


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """Hash of each run of so many lower-case words, repeats included; of all words if there are fewer."""
    parts = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), f"{WHITE_SPACE}+"), "")

    def hashed(parts: Column) -> Column:
        runs = F.greatest(F.size(parts) - words, F.when(F.size(parts) > 0, 0).otherwise(-1))
        starts = F.when(runs >= 0, F.sequence(F.lit(0), F.greatest(runs, F.lit(0)))).otherwise(
            F.array().cast("array<int>")
        )
        return F.transform(starts, lambda i: F.xxhash64(*(F.get(parts, i + k) for k in range(words))))

    # transform over a one-element array names the words, so that they are split once
    return F.flatten(F.transform(F.array(parts), hashed))


def sketch(text: Column, words: int = WORDS, scale_bits: int = SCALE_BITS) -> Column:
    """Distinct hashes below 2 ** -scale_bits of their range, in order.

    A text with words of whose hashes none is that small keeps its least hash, so that it has a fingerprint of its
    own; estimates leave that hash aside (``supported``). Null and texts without words have an empty sketch.
    """

    def kept(hashes: Column) -> Column:
        small = F.filter(hashes, lambda h: F.shiftrightunsigned(h, 64 - scale_bits) == 0)
        least = F.array_min(F.transform(hashes, lambda h: h.bitwiseXOR(F.lit(-(1 << 63))))).bitwiseXOR(F.lit(-(1 << 63)))
        fallback = F.when(F.size(hashes) > 0, F.array(least)).otherwise(hashes)
        return F.when(F.size(small) > 0, F.array_sort(F.array_distinct(small))).otherwise(fallback)

    return F.flatten(F.transform(F.array(shingle_hashes(text, words)), kept))


def supported(a: Column, scale_bits: int = SCALE_BITS) -> Column:
    """The hashes of a sketch below the threshold: a fair sample of the shingles, whatever else the text has."""
    return F.filter(a, lambda h: F.shiftrightunsigned(h, 64 - scale_bits) == 0)


def merged(a: Column, b: Column, scale_bits: int = SCALE_BITS) -> Column:
    """The sketch of two texts taken together: the hashes of both, or the lesser of two that are left for want of others."""
    small = F.array_sort(F.array_union(supported(a, scale_bits), supported(b, scale_bits)))
    rest = F.array_union(a, b)
    top = F.lit(-(1 << 63))
    least = F.array_min(F.transform(rest, lambda h: h.bitwiseXOR(top))).bitwiseXOR(top)
    return F.when(F.size(small) > 0, small).when(F.size(rest) > 0, F.array(least)).otherwise(rest)


def containment(a: Column, b: Column, scale_bits: int = SCALE_BITS) -> Column:
    """Estimated share of the shingles of a that b has; 1 if a has none.

    Null if a has shingles, but no hash below the threshold: then nothing supports an estimate.
    """
    small = supported(a, scale_bits)
    shared = F.size(F.array_intersect(small, b)) / F.greatest(F.size(small), F.lit(1))
    return F.when(F.size(a) == 0, 1.0).when(F.size(small) > 0, shared)


def resemblance(a: Column, b: Column) -> Column:
    """Estimated shared shingles over all of both; 1 if neither has any."""
    shared = F.size(F.array_intersect(a, b))
    together = F.size(a) + F.size(b) - shared
    return F.when(together == 0, 1.0).otherwise(shared / F.greatest(together, F.lit(1)))


def as_text(hashes: Column) -> Column:
    """16 hexadecimal digits for each hash."""
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def next_rows(docs: DataFrame, order: str, text: str, row: str) -> DataFrame:
    """``row``, ``order``, ``n_chars`` and ``next_row``: the row that follows in descending order, after the last the first.

    Nulls come last, ties by row. Rows are sorted over all partitions; each partition finds its own neighbours, and
    one row for each partition tells what follows at its end.
    """
    ids = docs.select(row, F.col(order).alias("_order"), F.char_length(F.coalesce(text, F.lit(""))).cast("long").alias("n_chars"))
    by = [F.desc_nulls_last("_order"), F.col(row)]
    parts = stored(ids.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()), "order")
    within = Window.partitionBy("_part").orderBy(*by)
    found = parts.withColumn("_next", F.lead(row).over(within)).withColumn("_at", F.row_number().over(within))
    found = stored(found, "neighbours")
    firsts = found.where("_at = 1").select("_part", F.col(row).alias("_first"))
    across = Window.orderBy("_part")
    whole = across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = firsts.select("_part", F.coalesce(F.lead("_first").over(across), F.first("_first").over(whole)).alias("_follows"))
    # One row for each partition of the sort.
    return found.join(F.broadcast(ends), "_part").select(
        row, F.col("_order").alias(order), "n_chars", F.coalesce("_next", "_follows").alias("next_row")
    )


def fingerprint_edited(
    docs: DataFrame,
    *,
    order: str = "doc_id",
    text: str = "text",
    row: str | None = None,
    words: int = WORDS,
    scale_bits: int = SCALE_BITS,
) -> DataFrame:
    """Each row's ``order`` column, ``n_chars``, ``edited``, and the sketches ``own``, ``edited_sketch``, ``next_sketch``.

    ``edited`` is the text with its last floor(n_chars / 2) code points replaced by the first as many, or all, of
    the next row in descending order. Null text is empty. A single row is its own next. ``row`` names a column that
    identifies a row each time it is read; without it one is made. Rows with one ``order`` value follow each other by
    ``row``, those without one come last. An empty table gives no rows. Other columns are not read.
    """
    docs, key = (docs, row) if row else with_row_key(docs.select(order, text))
    plain = F.coalesce(F.col(text), F.lit(""))
    # Read by both joins with the same columns and key, so that whole texts are shuffled once.
    texts = docs.select(key, plain.alias("_text")).withColumn("own", sketch(F.col("_text"), words, scale_bits))
    follows = stored(next_rows(docs, order, text, key), "next").alias("f")
    half = F.expr("n_chars div 2").cast("int")
    handed = follows.join(texts.hint("merge").alias("t"), F.col("f.next_row") == F.col(f"t.{key}")).select(
        F.col(f"f.{key}"),
        order,
        "n_chars",
        F.substring(F.col("_text"), F.lit(1), half).alias("_head"),
        F.col("own").alias("next_sketch"),
    )
    joined = texts.join(handed.hint("merge"), key)
    kept = F.substring(F.col("_text"), F.lit(1), (F.col("n_chars") - half).cast("int"))
    return joined.select(order, "n_chars", "own", "next_sketch", F.concat(kept, "_head").alias("edited")).withColumn(
        "edited_sketch", sketch(F.col("edited"), words, scale_bits)
    )
