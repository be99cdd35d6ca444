"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starboard.llm.common import stored


def _with_least(pairs: DataFrame) -> DataFrame:
    """(u, v) and the least of u and all v of the same u. Joined, not windowed, so that a hub can be split."""
    least = pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("least"))
    return pairs.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    found = _with_least(edges)
    moved = found.where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return moved.unionByName(found.select("u", F.col("least").alias("v")))


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node`` and ``root`` (the least node of its component) for each node that has a link to another.

    Each round writes its edges to the shared folder. It ends when a round changes nothing; the number of rounds
    grows with the logarithm of the number of nodes. Rows with a null end are no links.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    edges = stored(edges, "edges")
    seen = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        edges = stored(_small_star(_large_star(edges).distinct()).where("u <> v").distinct(), "edges")
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
