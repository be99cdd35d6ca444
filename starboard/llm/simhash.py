"""SimHash near-duplicates: fingerprints, generalised pigeonhole search, components."""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starboard.llm.common import rank_of, ship_code, stored
from starboard.llm.components import connected_components

BITS = 64
SEED = 42
# Members of one bucket that are compared in pairs; the members of a larger one meet at the points around them.
PAIRWISE = 16


def text_fingerprint(text: str | None, words_per_shingle: int) -> int:
    """The 64 majority bits of the shingles' XXH64, as a signed integer; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # both ASCII only
    if not words:
        return 0
    n = min(words_per_shingle, len(words))
    shingles = map(b" ".join, zip(*(words[i:] for i in range(n))))
    digest, counts, total = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64), 0
    while chunk := [digest(s, SEED) for s in itertools.islice(shingles, 1 << 16)]:
        bits = np.unpackbits(np.array(chunk, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
        total += len(chunk)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<i8")[0])


def with_fingerprint(docs: DataFrame, text: str, words_per_shingle: int, name: str = "fingerprint") -> DataFrame:
    """``docs`` without ``text``, with the fingerprint of the whole text."""
    ship_code(docs.sparkSession)

    @F.pandas_udf("long")
    def fingerprints(texts: pd.Series) -> pd.Series:
        return pd.Series([text_fingerprint(t, words_per_shingle) for t in texts], dtype="int64")

    return docs.select(*(c for c in docs.columns if c != text), fingerprints(F.col(text)).alias(name))


def bit_statistics(prints: DataFrame, column: str) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and for each two bits how many have both. Tasks add up, 64 x 64 sums reach the driver."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS), np.int64), 0
        for batch in batches:
            values = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False)).astype("<i8")
            for part in np.array_split(values, len(values) // 65_536 + 1):
                bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total += (bits.T @ bits).astype(np.int64)
                n += len(part)
        flat = [n, *total.reshape(-1).tolist()]
        yield pa.RecordBatch.from_pydict({"at": pa.array(range(len(flat)), pa.int32()), "n": pa.array(flat, pa.int64())})

    rows = prints.select(column).mapInArrow(sums, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(1 + BITS * BITS, np.int64)
    for r in rows:
        flat[r["at"]] = r["n"]
    return int(flat[0]), flat[1:].reshape(BITS, BITS)


def correlated_partitions(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in groups of nearly equal size; each grows by the bit most correlated with its members."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    rho = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(rho, 0)
    free, groups = set(range(BITS)), []
    for size in (BITS * (i + 1) // parts - BITS * i // parts for i in range(parts)):
        group = [max(free, key=lambda b: (rho[b, sorted(free)].sum(), -b))]
        free.remove(group[0])
        while len(group) < size:
            group.append(max(free, key=lambda b: (rho[b, group].mean(), -b)))
            free.remove(group[-1])
        groups.append(sorted(group))
    return groups


def masks(bits: Sequence[int], most: int) -> list[tuple[int, int]]:
    """(number of bits, mask) for all choices of at most so many bits, signed."""
    out = []
    for d in range(most + 1):
        for chosen in itertools.combinations(bits, d):
            value = sum(1 << b for b in chosen)
            out.append((d, value - (1 << 64) if value >> 63 else value))
    return out


def _within(p: np.ndarray, group: Sequence[int], most: int) -> list[float]:
    """Chance that two fingerprints differ in at most 0, 1, ... bits of the group, if bits were independent."""
    chance = np.zeros(most + 1)
    chance[0] = 1
    for b in group:
        differ = 2 * p[b] * (1 - p[b])
        chance = chance * (1 - differ) + np.concatenate([[0], chance[:-1]]) * differ
    return np.cumsum(chance).tolist()


def allocate(costs: Sequence[Sequence[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds that add up to ``total`` at least cost. ``costs[i][t + 1]`` is for threshold t of part i, from -1."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        following: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for t, c in enumerate(row, -1):
                if (new := (cost + c, [*chosen, t])) < following.get(spent + t, (float("inf"), [])):
                    following[spent + t] = new
        best = following
    return best[total]


def plan_probes(prints: DataFrame, column: str, distance: int) -> list[tuple[list[int], int]]:
    """Parts of correlated bits with their thresholds, for the number of parts that costs least.

    By the generalised pigeonhole principle two fingerprints within ``distance`` bits are within threshold t_i
    in some part i, if the thresholds (from -1, a part not probed) add up to distance - parts + 1. Costs are
    estimated from all fingerprints: pairs that share a part's value are counted, and scaled by the chance of a
    few differing bits for higher thresholds; the probes themselves count too.
    """
    n, both = bit_statistics(prints, column)
    if n < 2:
        return []
    p, options = np.diag(both) / n, {m: correlated_partitions(n, both, m) for m in range(1, distance + 2)}
    values = [
        F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), F.col(column).bitwiseAND(_mask(g)).alias("value"))
        for m, groups in options.items()
        for i, g in enumerate(groups)
    ]
    shared = prints.select(F.explode(F.array(*values)).alias("s")).groupBy("s.m", "s.i", "s.value").count()
    pairs = F.least(F.col("count") * (F.col("count") - 1) / 2, F.col("count") * (BITS + 1.0))
    counted = {(r["m"], r["i"]): r["pairs"] for r in shared.groupBy("m", "i").agg(F.sum(pairs).alias("pairs")).collect()}
    best = None
    for m, groups in options.items():
        costs = []
        for i, g in enumerate(groups):
            chance = _within(p, g, distance)
            row = [0.0]
            for t in range(distance + 1):
                row.append(counted[m, i] * chance[t] / max(chance[0], 1e-300) + 2.0 * n * len(masks(g, t)))
            costs.append(row)
        cost, thresholds = allocate(costs, distance - m + 1)
        if best is None or cost < best[0]:
            best = (cost, [(g, t) for g, t in zip(groups, thresholds) if t >= 0])
    return best[1]


def _mask(bits: Sequence[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >> 63 else value


def near_links(prints: DataFrame, column: str, distance: int) -> DataFrame:
    """Links (a, b) between distinct fingerprints; their components are those of all pairs within ``distance`` bits.

    Every fingerprint probes the parts of ``plan_probes``. Members of a small bucket are compared pair by pair.
    Those of larger buckets are not paired: each goes to all points within ceil(distance / 2) bits of it, and
    two fingerprints are within ``distance`` exactly if they meet at a point that is within floor(distance / 2)
    bits of one of them. All who meet are linked to one of them. Both ways are exact.
    """
    signatures = []
    for i, (group, threshold) in enumerate(plan_probes(prints, column, distance)):
        for d, mask in masks(group, threshold):
            key = F.col(column).bitwiseAND(_mask(group)).bitwiseXOR(F.lit(mask))
            signatures.append(F.struct(F.lit(i).alias("part"), key.alias("key"), F.lit(d == 0).alias("own")))
    if not signatures:
        return prints.select(F.col(column).alias("a"), F.col(column).alias("b")).where("false")
    probes = prints.select(F.col(column).alias("f"), F.explode(F.array(*signatures)).alias("s"))
    probes = probes.select("s.part", "s.key", "s.own", "f")
    sizes = probes.groupBy("part", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    buckets = stored(probes.join(stored(sizes, "bucket-sizes"), ["part", "key"]), "buckets")

    small = buckets.where(F.col("size") <= PAIRWISE)
    a = small.select("part", "key", F.col("f").alias("a"), F.col("own").alias("own_a"))
    b = small.select("part", "key", F.col("f").alias("b"), F.col("own").alias("own_b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    compared = a.join(b, ["part", "key"]).where((F.col("a") < F.col("b")) & (F.col("own_a") | F.col("own_b")) & near)

    around = [
        F.struct(F.lit(mask).alias("mask"), F.lit(d <= distance // 2).alias("close"))
        for d, mask in masks(range(BITS), -(-distance // 2))
    ]
    large = buckets.where(F.col("size") > PAIRWISE).select("f").distinct()
    points = large.select("f", F.explode(F.array(*around)).alias("m")).select(
        F.col("f").bitwiseXOR(F.col("m.mask")).alias("point"), "f", "m.close"
    )
    # A point has no more fingerprints than there are masks, so these lists are bounded.
    met = points.groupBy("point").agg(
        F.collect_list("f").alias("all"), F.min(F.when(F.col("close"), F.col("f"))).alias("b")
    )
    met = met.where((F.size("all") > 1) & F.col("b").isNotNull())
    met = met.select(F.explode("all").alias("a"), "b").where("a <> b")
    return compared.select("a", "b").unionByName(met).distinct()


def simhash_components(
    docs: DataFrame,
    *,
    order: Sequence[str] = ("doc_id",),
    text: str = "text",
    row: str | None = None,
    words_per_shingle: int = 3,
    distance: int = 2,
) -> DataFrame:
    """For each row of ``docs``: its fingerprint and the first row, by ``order``, that links lead to.

    Returns ``row``, the ``order`` columns, ``fingerprint`` (signed long) and ``first``, a struct of the order
    columns of the component's first row, nulls last. Rows link if their fingerprints differ in at most
    ``distance`` bits. Null and empty texts have fingerprint 0 and link like any other. Other columns are not read.
    """
    key = row or "_row"
    if row is None:
        docs = docs.select(*order, text).withColumn(key, F.monotonically_increasing_id())
    carry = [c for c in order if c != key]
    found = stored(with_fingerprint(docs.select(key, *carry, text), text, words_per_shingle), "fingerprints")
    found = found.withColumn("_rank", rank_of(order, key))
    prints = stored(found.groupBy("fingerprint").agg(F.min("_rank").alias("_least")), "distinct-fingerprints")
    linked = connected_components(near_links(prints, "fingerprint", distance), "a", "b")
    rooted = prints.join(stored(linked, "components"), F.col("fingerprint") == F.col("node"))
    firsts = rooted.groupBy("root").agg(F.min("_least").alias("first"))
    moved = stored(rooted.select("fingerprint", "root").join(firsts, "root").select("fingerprint", "first"), "linked")
    single = prints.join(moved, "fingerprint", "left").select(
        "fingerprint", F.coalesce("first", "_least").alias("first")
    )
    return found.join(stored(single, "firsts"), "fingerprint").select(key, *carry, "fingerprint", "first")
