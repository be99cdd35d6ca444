"""Lines that many sites share: HyperLogLog spread, exact near the threshold, then removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starboard.llm.common import WHITE_SPACE, stored, with_row_key

MIN_SITES = 10
LOG_REGISTERS = 12


def trimmed(line: Column) -> Column:
    """A line without white space at its ends."""
    return F.regexp_replace(line, f"^{WHITE_SPACE}+|{WHITE_SPACE}+$", "")


def _without(text: Column, gone: Column) -> Column:
    """The text without the lines of these numbers: what lies between each two of them, in one pass over the lines."""
    split = F.split(text, "\n")
    ends = F.concat(F.array(F.lit(-1)), F.array_sort(gone), F.array(F.size(split)))

    def between(s: Column) -> Column:
        pairs = F.sequence(F.lit(1), F.size(s["ends"]) - 1)
        before, after = (lambda i: F.get(s["ends"], i - 1)), (lambda i: F.get(s["ends"], i))
        return F.flatten(F.transform(pairs, lambda i: F.slice(s["lines"], before(i) + 2, after(i) - before(i) - 1)))

    # transform over a one-element array names the lines and the ends, so that they are made once
    return F.array_join(F.get(F.transform(F.array(F.struct(split.alias("lines"), ends.alias("ends"))), between), 0), "\n")


def spread_lines(lines: DataFrame, *, min_sites: int, log_registers: int) -> DataFrame:
    """``line`` (hash) and ``sites`` of the lines on at least ``min_sites`` sites, from rows (``line``, ``site``).

    Each task keeps one sketch for each line it sees, and sketches of a line are merged. An estimate is off by
    more than five standard errors (or one site) practically never: beyond that it decides; the lines within it of
    the threshold are counted exactly. ``sites`` is the exact number for those, an estimate for the others.
    """
    margin = max(1.0, 5 * min_sites * 1.04 / 2 ** (log_registers / 2))
    sketches = lines.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(log_registers)).alias("sketch"))
    estimated = sketches.select("line", F.hll_sketch_estimate("sketch").alias("sites"))
    wide = stored(estimated.where(F.col("sites") >= min_sites - margin), "line-spread")
    near = wide.where(F.col("sites") <= min_sites + margin).select("line")
    exact = lines.join(near, "line", "left_semi").distinct().groupBy("line").agg(F.count(F.lit(1)).alias("sites"))
    exact = exact.where(F.col("sites") >= min_sites)
    return wide.where(F.col("sites") > min_sites + margin).unionByName(exact)


def remove_shared_lines(
    docs: DataFrame,
    *,
    carry: tuple[str, ...] = ("doc_id",),
    text: str = "text",
    site: str = "source",
    row: str | None = None,
    min_sites: int = MIN_SITES,
    log_registers: int = LOG_REGISTERS,
) -> DataFrame:
    """``carry``, ``text`` without the lines that ``min_sites`` sites or more have, ``n_lines`` and ``n_removed``.

    Lines are parted by a line feed and compared without white space at their ends; empty ones are kept and not
    counted as shared. All places of a shared line go. A null site is no site. Null text stays null, with no lines.
    Lines go by their 64-bit hash. ``row`` names a column that identifies a row each time it is read; without it
    one is made. Repeated rows are rows of their own, of one site each. An empty table gives no rows. Other columns are
    not read. A text of many lines takes time in proportion to them.
    """
    docs, key = (docs, row) if row else with_row_key(docs.select(*dict.fromkeys([*carry, text, site])))
    split = F.split(F.col(text), "\n")
    hashed = F.transform(split, lambda x: F.when(trimmed(x) != "", F.xxhash64(trimmed(x))))
    places = docs.select(key, F.col(site).alias("site"), F.posexplode(hashed).alias("at", "line")).where("line IS NOT NULL")
    places = stored(places, "lines")
    shared = spread_lines(
        places.where("site IS NOT NULL").select("line", "site"), min_sites=min_sites, log_registers=log_registers
    )
    # A left join is not narrowed to a semi join, so that a line with many places can be split over tasks.
    gone = places.join(stored(shared, "shared-lines").select("line"), "line")
    found = gone.groupBy(key).agg(F.collect_set("at").alias("_gone"))
    lines = docs.select(key, *carry, F.col(text).alias("_text"))
    # Merged at every size: the removed places grow with the documents, and are not to be broadcast.
    joined = lines.join(stored(found, "removed-lines").hint("merge"), key, "left")
    cleaned = F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(_without(F.col("_text"), F.col("_gone")))
    return joined.select(
        *carry,
        cleaned.alias(text),
        F.coalesce(F.size(F.split("_text", "\n")), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"),
    ).withColumn("n_lines", F.greatest("n_lines", F.lit(0))).withColumn("n_removed", F.greatest("n_removed", F.lit(0)))
