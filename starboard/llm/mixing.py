"""Sources mixed to target weights by Pfair scheduling of their blocks."""

from __future__ import annotations

import functools
import heapq
import itertools
import math
from bisect import bisect_left
from collections.abc import Iterator, Mapping, Sequence
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starboard.llm.common import ship_code, stored, with_row_key

BLOCK_ROWS = 64
# Rows of one source that are ordered together; larger sources are cut by their hash.
CHUNK_ROWS = 2_000
# Slots of the schedule that are handed over together.
SLOT_ROWS = 10_000
# Slots that one task schedules, and tasks that the stretches are dealt to at most.
STRETCH_SLOTS = 1 << 17
MOST_TASKS = 2_000


class Ideal:
    """The ideal mix: all sources flow at once, each at its weight's share among those that have something left.

    Times are exact integers or fractions, whatever the weights and however many sources.
    """

    def __init__(self, blocks: Mapping[str | None, int], weights: Mapping[str | None, float]):
        self.count = {s: n for s, n in blocks.items() if n > 0}
        if self.count and min(weights[s] for s in self.count) <= 0:
            raise ValueError("weights must be above 0")
        given = {s: Fraction(weights[s]) for s in self.count}
        scale = math.lcm(*(w.denominator for w in given.values()))
        self.weight = {s: int(w * scale) for s, w in given.items()}
        self.rank = {s: i for i, s in enumerate(sorted(self.count, key=lambda s: (s is None, s)))}
        self.ends = sorted(self.count, key=lambda s: Fraction(self.count[s], self.weight[s]))
        # When so many sources have ended: their blocks, and the weights of the others.
        self.ended = [0, *itertools.accumulate(self.count[s] for s in self.ends)]
        self.rates = [*itertools.accumulate((self.weight[s] for s in reversed(self.ends)), initial=0)][::-1]
        self.slots = self.ended[-1]

    def time(self, s: str | None, i: int) -> tuple[int, int]:
        """Whole slots, and the rest in parts of the source's weight, until the ideal has i blocks of the source."""
        weight, count = self.weight, self.count
        over = bisect_left(self.ends, True, key=lambda e: count[e] * weight[s] > i * weight[e])
        whole, rest = divmod(self.rates[over] * i, weight[s])
        return self.ended[over] + whole, rest

    def due(self, s: str | None, i: int) -> int:
        """The slot by which block i is to be through: the ideal has i + 1, rounded up."""
        whole, rest = self.time(s, i + 1)
        return whole + (rest > 0)

    def had(self, slot: int) -> dict[str | None, tuple[int, bool]]:
        """For each source the whole blocks that the ideal has after so many slots, and whether a part of another."""
        over = bisect_left(self.ends, True, key=lambda e: self.time(e, self.count[e])[0] >= slot)
        rate = self.rates[over]
        # What a weight of 1 has had by now, as a fraction.
        flown = slot - self.ended[over]
        out = {}
        for s, w in self.weight.items():
            whole, rest = divmod(w * flown, rate) if rate else (self.count[s], 0)
            out[s] = (whole, rest > 0) if whole < self.count[s] else (self.count[s], False)
        return out


def blocks_before(ideal: Ideal, slot: int) -> dict[str | None, int]:
    """Blocks of each source in the first ``slot`` slots of a mix that can be scheduled on both sides of the cut.

    Blocks that are due by then are before the cut, those released later are after it. Of the blocks that the ideal has
    begun, as many go before it as there is room for. They go by deadline, a block only if those released as late or later fit
    into the slots that are left for them. That greedy choice leaves the fewest early deadlines to the other side, as sets
    that fit are a matroid; and since some schedule of the whole mix exists, what it leaves can be met.
    """
    had = ideal.had(slot)
    before = {s: whole for s, (whole, _) in had.items()}
    room = slot - sum(before.values())
    if not room:
        return before
    begun = [s for s, (_, part) in had.items() if part]
    release = {s: ideal.time(s, before[s])[0] for s in begun}
    times = sorted(set(release.values()))
    # Slots from each release to the cut that blocks due by the cut do not need.
    free = []
    for t in times:
        later = {s: whole + part for s, (whole, part) in ideal.had(t).items()}
        free.append(slot - t - sum(max(0, before[s] - later[s]) for s in before))
    for s in sorted(begun, key=lambda s: (ideal.due(s, before[s]), ideal.rank[s])):
        own = bisect_left(times, release[s]) + 1
        if room and min(free[:own]) > 0:
            free[:own] = [f - 1 for f in free[:own]]
            before[s] += 1
            room -= 1
    if room:
        raise AssertionError("the cut has no room for a block")
    return before


def stretch(
    ideal: Ideal, first: int, before: Mapping[str | None, int], end: int, through: Mapping[str | None, int]
) -> Iterator[tuple[str | None, int]]:
    """The source and the number of its block for each slot from ``first`` to ``end``.

    ``before`` and ``through`` say how many blocks of each source are in the mix at both ends. Block i of a source is
    released when the ideal has i of its blocks and due when it has i + 1, the release rounded down and the deadline up to
    whole slots. In each slot the released block that is due first goes, ties by source. The ideal itself shows that
    all deadlines can be met, so the earliest first meets them, and after any number of slots each source has had
    what the ideal gives it, give or take less than one block. What is kept is one block for each source.
    """

    def next_block(s: str | None, i: int) -> tuple:
        return max(first, ideal.time(s, i)[0]), ideal.rank[s], s, i

    waiting = [next_block(s, before[s]) for s in ideal.count if before[s] < through[s]]
    heapq.heapify(waiting)
    ready: list[tuple] = []
    for t in range(first, end):
        while waiting and waiting[0][0] <= t:
            _, r, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (min(end, ideal.due(s, i)), r, s, i))
        due, r, s, i = heapq.heappop(ready)
        if due <= t:
            raise AssertionError("a deadline was missed")
        yield s, i
        if i + 1 < through[s]:
            heapq.heappush(waiting, next_block(s, i + 1))


def exact(blocks: Mapping[str | None, int], weights: Mapping[str | None, float]) -> Iterator[tuple[str | None, int]]:
    """The whole mix in one stretch, by the weights as they are given."""
    ideal = Ideal(blocks, weights)
    yield from stretch(ideal, 0, dict.fromkeys(ideal.count, 0), ideal.slots, ideal.count)


def edges_of(ideal: Ideal, slots: int) -> list[int]:
    """Where the mix is cut into stretches of ``slots`` slots; longer ones where there are so many sources that a cut costs more."""
    slots = max(slots, len(ideal.count) ** 2 // 8)
    return [*range(0, ideal.slots, slots), ideal.slots]


def mix_sources(
    docs: DataFrame,
    *,
    weights: Mapping[str | None, float] | None = None,
    power: float = 0.5,
    carry: Sequence[str] = ("doc_id",),
    source: str = "source",
    by: Sequence[str] | None = None,
    seed: int = 0,
    block_rows: int = BLOCK_ROWS,
    stretch_slots: int = STRETCH_SLOTS,
) -> DataFrame:
    """``carry``, ``source``, ``block`` (within its source), ``slot`` (of the block in the mix), ``place`` (in the block).

    Sorting by (slot, place) gives the mix. Rows of a source are shuffled by a hash of the columns ``by`` (``carry``,
    if none are named) and the seed and cut into blocks of ``block_rows``, the last one maybe shorter. ``weights`` are the
    sources' shares of blocks; without them they follow the sources' sizes to the power ``power``. Weights are kept
    exactly, over the whole mix (see ``stretch``). Every row comes once: when a source ends, the others go on by their
    weights. A null source is a source. Rows alike in ``by`` follow each other in any order; rows that have only nulls
    there are shuffled by their place in their files instead, so that they do not meet in one task. The mix is cut into
    stretches of ``stretch_slots`` blocks, each scheduled by a task of its own, within one block of the ideal all the way;
    one task goes through the sources and finds the cuts. The driver sees neither. A source without weight, or a weight not
    above 0, is an error. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    stretch_schema = pa.schema(
        [("first", pa.int64()), ("end", pa.int64()), ("names", pa.list_(pa.string())), ("blocks", pa.list_(pa.int64()))]
        + [("weights", pa.list_(pa.float64())), ("before", pa.list_(pa.int64())), ("through", pa.list_(pa.int64()))]
    )
    by = list(by or carry)
    docs, row = with_row_key(docs.select(*dict.fromkeys([*carry, source, *by])))
    names = [F.col(c) for c in carry]
    mixed = F.xxhash64(F.lit(seed), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by))
    nothing = functools.reduce(lambda a, b: a & b, (F.col(c).isNull() for c in by))
    mixed = F.when(nothing, F.xxhash64(F.lit(seed), F.col(row))).otherwise(mixed)
    keyed = docs.select(*names, F.col(source).alias("_s"), mixed.alias("_h"))
    sizes = stored(keyed.groupBy("_s").agg(F.count(F.lit(1)).alias("n")), "sources")
    if weights is not None:
        known = spark.createDataFrame([(s, float(w)) for s, w in weights.items()], "_known string, w double")
        sizes = sizes.join(known, F.col("_s").eqNullSafe(F.col("_known")), "left").select("_s", "n", "w")
        if missing := [r["_s"] for r in sizes.where("w IS NULL").limit(5).collect()]:
            raise ValueError(f"sources without a weight: {missing}")
    else:
        sizes = sizes.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(float(power))))
    if not sizes.where("NOT w > 0").isEmpty():
        raise ValueError("weights must be above 0")

    # A row's number in its source: rows of earlier chunks, and its number in its own chunk.
    cuts = sizes.select("_s", F.ceil(F.col("n") / CHUNK_ROWS).cast("long").alias("_cuts")).alias("cuts")
    cut = keyed.alias("k").join(cuts, F.col("k._s").eqNullSafe(F.col("cuts._s")))
    cut = cut.select(*(F.col(f"k.{c}") for c in carry), F.col("k._s").alias("_s"), "_h", "_cuts")
    span = F.lit(2.0**64)
    chunk = F.least(((F.col("_h") + F.lit(2.0**63)) / span * F.col("_cuts")).cast("long"), F.col("_cuts") - 1)
    cut = stored(cut.select(*carry, "_s", "_h", chunk.alias("_chunk")), "chunks")
    counts = cut.groupBy("_s", "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_s").orderBy("_chunk")) - F.col("_n")
    counts = counts.select("_s", "_chunk", before.alias("_before"))
    within = F.row_number().over(Window.partitionBy("_s", "_chunk").orderBy("_h", *names))
    rows = cut.withColumn("_i", within).alias("r")
    counts = stored(counts, "chunk-offsets").alias("c")
    same = F.col("r._s").eqNullSafe(F.col("c._s")) & (F.col("r._chunk") == F.col("c._chunk"))
    rows = rows.join(counts, same)
    at = F.col("_before") + F.col("_i") - 1
    rows = rows.select(
        *(F.col(f"r.{c}") for c in carry),
        F.col("r._s").alias("_s"),
        F.floor(at / block_rows).alias("block"),
        (at % block_rows).cast("int").alias("place"),
    )

    def sources(batches: Iterator[pa.RecordBatch]) -> tuple[dict, dict]:
        blocks, wanted = {}, {}
        for batch in batches:
            for s, n, w in zip(*(batch.column(c).to_pylist() for c in ("_s", "n", "w"))):
                blocks[s], wanted[s] = -(-n // block_rows), w
        return blocks, wanted

    def planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, wanted = sources(batches)
        ideal = Ideal(blocks, wanted)
        names = list(ideal.count)
        edges, before = edges_of(ideal, stretch_slots), dict.fromkeys(names, 0)
        for first, end in zip(edges, edges[1:]):
            through = blocks_before(ideal, end)
            lists = [names, [blocks[s] for s in names], [wanted[s] for s in names], [before[s] for s in names], [through[s] for s in names]]
            yield pa.RecordBatch.from_pylist([dict(zip(stretch_schema.names, [first, end, *lists]))], schema=stretch_schema)
            before = through

    def scheduled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for batch in batches for r in batch.to_pylist()):
            names = row["names"]
            ideal = Ideal(dict(zip(names, row["blocks"])), dict(zip(names, row["weights"])))
            before, through = dict(zip(names, row["before"])), dict(zip(names, row["through"]))
            order = stretch(ideal, row["first"], before, row["end"], through)
            for first in itertools.count(row["first"], SLOT_ROWS):
                if not (some := list(itertools.islice(order, SLOT_ROWS))):
                    break
                found, numbers = zip(*some)
                columns = [pa.array(found, pa.string()), pa.array(numbers, pa.int64())]
                columns.append(pa.array(range(first, first + len(some)), pa.int64()))
                yield pa.RecordBatch.from_arrays(columns, ["_s2", "_block2", "slot"])

    # One row for each block. A key has the rows of one block, whatever the size of its source.
    ship_code(spark)
    in_one = sizes.select(F.col("_s").cast("string").alias("_s"), "n", "w").coalesce(1)
    plan = "first long, end long, names array<string>, blocks array<long>, weights array<double>, before array<long>, through array<long>"
    stretches = stored(in_one.mapInArrow(planned, plan), "stretches")
    spread = stretches.repartition(min(max(stretches.count(), 1), MOST_TASKS))
    slots = stored(spread.mapInArrow(scheduled, "_s2 string, _block2 long, slot long"), "slots")
    rows = rows.join(slots, F.col("_s").eqNullSafe(F.col("_s2")) & (F.col("block") == F.col("_block2")))
    return rows.select(*carry, F.col("_s").alias(source), "block", "slot", "place")
