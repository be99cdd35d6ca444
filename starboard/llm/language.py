"""Language by rank-order profiles of character n-grams."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starboard.llm.common import ship_code

PROFILE = 400
UNKNOWN = "und"
SPACE = 32
# At so many n-grams a text needs half the score of a long one: the words of a clean short text may all be rare.
HALF = 16
# Share of the known rows that the threshold leaves aside, and how far below the others it lies.
STRAY = 0.01
MARGIN = 2 / 3
# What stands in for known rows where there are few.
PRIOR = 0.5
PRIOR_ROWS = 20
# N-grams that a task counts before it hands them over.
HELD_GRAMS = 1 << 20


@functools.cache
def _word_characters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: whether it is a letter, and whether it belongs to a word (letters and marks)."""
    kinds = [unicodedata.category(chr(i))[0] for i in range(0x110000)]
    return np.array([k == "L" for k in kinds]), np.array([k in "LM" for k in kinds])


def ngrams(text: str | None) -> np.ndarray:
    """All n-grams of 1 to 3 characters of the words, in lower case and with one blank at each end, as integers.

    Empty if the text has no letter. Blanks stand only at the ends of an n-gram.
    """
    letters, in_word = _word_characters()
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if not letters[points].any():
        return np.empty(0, np.uint64)
    points = np.where(in_word[points], points, SPACE)
    points = np.concatenate([[SPACE], points, [SPACE]]).astype(np.uint64)
    blank = points == SPACE
    keep = ~(blank & np.concatenate([[False], blank[:-1]]))
    points, blank = points[keep], blank[keep]
    two = (points[:-1] << np.uint64(21)) | points[1:]
    three = (two[:-1] << np.uint64(21)) | points[2:]
    return np.concatenate([points[~blank], two, three[~blank[1:-1]]])


def _count(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(np.concatenate(codes), return_inverse=True)
    return found, np.bincount(at, weights=np.concatenate(counts), minlength=len(found)).astype(np.int64)


def learn_profiles(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE) -> dict[str, np.ndarray]:
    """For each language its most frequent n-grams, most frequent first, ties by code. All rows with a language count.

    Counts add up in Spark; the driver gets ``size`` n-grams for each language.
    """
    ship_code(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        fresh: dict[str, list[np.ndarray]] = {}

        def settle(name: str) -> None:
            codes = fresh.pop(name)
            known = total.get(name, (np.empty(0, np.uint64), np.empty(0, np.int64)))
            total[name] = _count([known[0], *codes], [known[1], *(np.ones(len(c), np.int64) for c in codes)])

        def handed_over() -> Iterator[pa.RecordBatch]:
            for name in list(fresh):
                settle(name)
            for name, (codes, counts) in total.items():
                columns = [pa.array([name] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(counts)]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "gram", "n"])
            total.clear()
            held.clear()

        held: dict[str, int] = {}
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                codes = ngrams(value.as_py())
                fresh.setdefault(name, []).append(codes)
                held[name] = held.get(name, 0) + len(codes)
                if held[name] > 1 << 20:
                    settle(name)
                    held[name] = 0
            if sum(len(codes) for codes, _ in total.values()) > HELD_GRAMS:
                yield from handed_over()
        yield from handed_over()

    labelled = docs.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    sums = labelled.mapInArrow(counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    at = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = sums.withColumn("at", at).where(F.col("at") <= size).collect()
    profiles: dict[str, list] = {}
    for r in sorted(top, key=lambda r: (r["lang"], r["at"])):
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return {name: np.array(grams, np.uint64) for name, grams in profiles.items()}


class Profiles:
    """Out-of-place distances to all languages at once."""

    def __init__(self, profiles: Mapping[str, np.ndarray], size: int):
        self.size, self.names = size, sorted(profiles)
        self.grams = np.unique(np.concatenate([profiles[n] for n in self.names])) if self.names else np.empty(0, np.uint64)
        self.ranks = np.full((len(self.names), len(self.grams)), -1, np.int64)
        for i, name in enumerate(self.names):
            self.ranks[i, np.searchsorted(self.grams, profiles[name])] = np.arange(len(profiles[name]))

    def best(self, text: str | None) -> tuple[str, float]:
        """The nearest language, ties by name, and 1 - distance as a share of the largest possible."""
        return self.nearest(text)[:2]

    def nearest(self, text: str | None) -> tuple[str, float, int]:
        """As ``best``, and the number of n-grams that were compared."""
        codes = ngrams(text)
        if not len(codes) or not len(self.grams):
            return UNKNOWN, 0.0, 0
        found, counts = np.unique(codes, return_counts=True)
        found = found[np.lexsort((found, -counts))][: self.size]
        at = np.minimum(np.searchsorted(self.grams, found), len(self.grams) - 1)
        ranks = np.where(self.grams[at] == found, self.ranks[:, at], -1)
        apart = np.where(ranks >= 0, np.abs(ranks - np.arange(len(found))), self.size).sum(axis=1)
        nearest = int(apart.argmin())
        return self.names[nearest], float(1 - apart[nearest] / (self.size * len(found))), len(found)


def identify(text: Column, profiles: Mapping[str, np.ndarray], size: int = PROFILE) -> Column:
    """Struct of ``lang``, ``score`` (0 to 1) and ``grams`` (n-grams compared, at most ``size``) for a whole text.

    The n-grams of the text are ranked by frequency, ties by code; each is out of place by the difference of its
    ranks in text and profile, or by ``size`` if the profile lacks it. ``und`` and 0 if the text is null or has no
    letter, or no profile was learned. The profiles are ``size`` integers for each language.
    """
    known = Profiles(profiles, size)

    @F.pandas_udf("lang string, score double, grams int")
    def found(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([known.nearest(t) for t in texts], columns=["lang", "score", "grams"])

    return found(text)


def in_training(doc_id: Column) -> Column:
    """Rows whose crc32 of the id as text leaves no remainder of 2 by 4; a null id is in training."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2, F.lit(True))


def identify_languages(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", name: str = "language"
) -> DataFrame:
    """``docs`` with a struct ``name``, in place of a column of that name: ``held_out``, ``lang_pred``, ``score``, ``grams``.

    Profiles are learned from the rows that are not held out and have a language; repeated rows count each time.
    Nearest languages that are equally near go by name. An empty table gives no rows.
    """
    ship_code(docs.sparkSession)
    profiles = learn_profiles(docs.where(in_training(F.col(doc_id))), text, lang)
    found = identify(F.col(text), profiles)
    held_out = (~in_training(F.col(doc_id))).alias("held_out")
    fields = (found["lang"].alias("lang_pred"), found["score"].alias("score"), found["grams"].alias("grams"))
    return docs.withColumn(name, F.struct(held_out, *fields))


def confidence(language: Column) -> Column:
    """The score on one scale for texts of all lengths: what a few n-grams score is lifted, by their number."""
    grams = language["grams"]
    return language["score"] * (grams + HALF) / F.greatest(grams, F.lit(1))


def least_confidence(known: DataFrame, confidence: str = "confidence") -> float:
    """The confidence that a text in a known language is to have, from those of clean texts.

    It is ``MARGIN`` times the one that all but ``STRAY`` of the rows of ``known`` reach, counted together with
    ``PRIOR_ROWS`` rows of confidence ``PRIOR``: so few rows say little, many rows alone decide, and a few wrong labels
    among them do not move it. The rule is the same for any number of rows. At most 3,000 counts reach the driver.
    """
    counts = {round(PRIOR * 1000): PRIOR_ROWS}
    for r in known.groupBy(F.floor(F.col(confidence) * 1000).alias("at")).agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r["at"]] = counts.get(r["at"], 0) + r["n"]
    rows, below = sum(counts.values()), 0
    for at in sorted(counts):
        below += counts[at]
        if below > STRAY * rows:
            return MARGIN * at / 1000
    return 0.0


def is_known(language: Column, least: float) -> Column:
    """Whether the text has letters and the language's confidence is at least so much."""
    return (language["lang_pred"] != UNKNOWN) & (confidence(language) >= least)
