"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starboard.llm.common import REMEMBERED_BYTES, Remembered, integer_names, ship_code, stored

BUCKETS = 1 << 16
TARGET_ROWS = 20_000
TOKEN = re.compile(r"\w+|[^\w\s]+")


class HashedNgrams:
    """Buckets of a text's tokens and pairs of adjacent tokens. Short words between white space are remembered."""

    def __init__(self, remembered: int = REMEMBERED_BYTES):
        self.known = Remembered(self._word, most=remembered)

    def _word(self, word: str) -> bytes:
        hashes = [xxhash.xxh32_intdigest(t.encode("utf-8", "surrogatepass")) for t in TOKEN.findall(word)]
        return np.array(hashes, "<u4").tobytes()

    def buckets(self, text: str | None, n: int) -> np.ndarray:
        joined = b"".join(map(self.known.__getitem__, (text or "").split()))
        one = np.frombuffer(joined, "<u4").astype(np.uint64)
        two = one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:]
        two ^= two >> np.uint64(29)
        return np.concatenate([one, two]) % np.uint64(n)


@functools.lru_cache(maxsize=1)
def hashed_ngrams() -> HashedNgrams:
    return HashedNgrams()


def bucket_counts(docs: DataFrame, text: str, target: str, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of each bucket in all rows, and in those where ``target`` is true.

    Tasks add up; ``buckets`` sums reach the driver.
    """
    ship_code(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, sums = hashed_ngrams(), np.zeros((2, buckets), np.int64)
        for batch in batches:
            for value, chosen in zip(batch.column(0), batch.column(1).to_pylist()):
                found = np.bincount(features.buckets(value.as_py(), buckets).astype(np.int64), minlength=buckets)
                sums[0] += found
                if chosen:
                    sums[1] += found
        at = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_pydict({"at": at.astype(np.int32), "n": sums[0, at], "n_target": sums[1, at]})

    made = docs.select(text, target).mapInArrow(counted, "at int, n long, n_target long")
    totals = np.zeros((2, buckets), np.int64)
    for r in made.groupBy("at").agg(F.sum("n").alias("n"), F.sum("n_target").alias("n_target")).collect():
        totals[:, r["at"]] = r["n"], r["n_target"]
    return totals[0], totals[1]


def log_ratios(raw: np.ndarray, target: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    """Log of target over raw probability of each bucket, with so many extra counts in each."""
    p = (target + smoothing) / (target.sum() + smoothing * len(target))
    q = (raw + smoothing) / (raw.sum() + smoothing * len(raw))
    return np.log(p) - np.log(q)


def numbered(rows: DataFrame, alike: list[str], name: str) -> DataFrame:
    """``rows`` with ``name``: a number from 0 among the rows alike in these columns, without the column ``_row``.

    Most rows are like no other and have 0 at once. The others are sorted over all partitions, so that a group may span
    several tasks.
    """
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"g.{c}")) for c in alike]
    groups = rows.groupBy(*alike).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*alike)
    groups = stored(groups, "repeated").alias("g")
    condition = functools.reduce(lambda a, b: a & b, same)
    single = rows.alias("r").join(groups, condition, "left_anti").withColumn(name, F.lit(0).cast("long"))
    many = rows.alias("r").join(groups, condition, "left_semi")
    kept = rows.columns
    placed = stored(integer_names(many, [*alike, "_row"], kept, "_row", "_place"), "places").alias("r")
    first = placed.groupBy(*alike).agg(F.min("_place").alias("_first")).alias("g")
    found = placed.join(first, condition).select(*(F.col(f"r.{c}") for c in kept), (F.col("_place") - F.col("_first")).alias(name))
    return single.select(*kept, name).unionByName(found).drop("_row")


def importance_sample(
    docs: DataFrame,
    targets: DataFrame,
    *,
    sample_rows: int | None = None,
    sample_share: float = 0.5,
    doc_id: str = "doc_id",
    text: str = "text",
    seed: int = 0,
    buckets: int = BUCKETS,
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """``doc_id``, ``log_weight``, ``sample_key``, ``position`` (from 0) and ``selected`` for each row of ``docs``.

    ``targets`` has the ids of rows of target quality; the target model is fitted on at most ``target_rows`` of
    them, those with the smallest hash of id and seed, the raw model on all rows. A text's log weight is the sum of
    its n-grams' log ratios. Adding Gumbel noise and taking the ``sample_rows`` (or that share) highest keys samples
    without replacement in proportion to the weights. Each row has noise of its own, also among rows with one id or none;
    it comes from seed, id, the text's hash and the row's number among those alike in both, so the same rows give the
    same sample whatever files they are in. Ties go by these too. Null and empty texts have weight 0; without targets
    all weights are 0. Null targets are no targets. An empty table gives no rows. Other columns are not read.
    """
    docs = docs.select(doc_id, text)
    mixed = F.xxhash64(F.lit(seed), F.col(doc_id))
    ids = targets.select(doc_id).where(F.col(doc_id).isNotNull()).distinct().orderBy(mixed, doc_id).limit(target_rows)
    chosen = ids.withColumn("_target", F.lit(True))
    # At most ``target_rows`` ids.
    flagged = docs.select(doc_id, text).join(F.broadcast(chosen), doc_id, "left")
    raw, target = bucket_counts(flagged.withColumn("_target", F.coalesce("_target", F.lit(False))), text, "_target", buckets)
    ratios = log_ratios(raw, target) if target.any() else np.zeros(buckets)

    @F.pandas_udf("double")
    def weights(texts: pd.Series) -> pd.Series:
        features = hashed_ngrams()
        return pd.Series([float(ratios[features.buckets(t, buckets).astype(np.int64)].sum()) for t in texts], dtype="float64")

    hashed = F.xxhash64(F.lit(seed + 1), F.col(text))
    scored = docs.select(F.col(doc_id).alias("_id"), hashed.alias("_text"), weights(F.col(text)).alias("log_weight"))
    scored = numbered(stored(scored.withColumn("_row", F.monotonically_increasing_id()), "weights"), ["_id", "_text"], "_nth")
    drawn = F.xxhash64(F.lit(seed + 1), "_id", "_text", "_nth")
    uniform = (F.shiftrightunsigned(drawn, 11) + F.lit(0.5)) / F.lit(2.0**53)
    scored = scored.withColumn("sample_key", F.col("log_weight") - F.log(-F.log(uniform)))
    scored = stored(scored.withColumn("_down", -F.col("sample_key")), "sample-keys")
    if sample_rows is None:
        sample_rows = round(scored.count() * sample_share)
    placed = integer_names(scored, ["_down", "_id", "_text", "_nth"], ["_id", "log_weight", "sample_key"], "_nth", "position")
    return placed.withColumnRenamed("_id", doc_id).withColumn("selected", F.col("position") < sample_rows)
