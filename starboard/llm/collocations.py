"""Phrase collocations: counts from depth-truncated suffix subtrees, partitioned by word prefixes."""

from __future__ import annotations

import re
from collections.abc import Container, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starboard.llm.common import ship_code, stored

WORDS = 5
MIN_COUNT = 100
TOP = 2000
SLICES = 32
# Suffixes that one task holds to build its subtrees.
GROUP_SUFFIXES = 2_000_000
# A task hands its counts over after so many words or bytes of text.
HELD_WORDS = 1_000_000
HELD_BYTES = 64 << 20
# Bits of the filter of frequent words, and buckets of prefixes for each group.
FILTER_BITS = 1 << 26
BITMAP_BITS = 32_768
BUCKETS_PER_GROUP = 64
UNKNOWN = "und"
# Words that have the same number in all tasks.
COMMON_WORDS = 1 << 17
# A-Z in lower case, all that ends a piece as one sign, all that parts words as another.
PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\x0d\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")
END, NOTHING = b"\n", b""
EDGE = re.compile(rb"[ \n]")
CHUNK = 1 << 20


def tokens(text: bytes) -> Iterator[list[bytes]]:
    """Words, ``END`` after each piece, and ``NOTHING`` here and there; a long text in several lists, cut between words."""
    text, at = text.translate(PLAIN), 0
    while at < len(text):
        edge = EDGE.search(text, at + CHUNK)
        to = edge.start() if edge else len(text)
        yield text[at:to].replace(END, b" \n ").split(b" ")
        at = to


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
            yield lang, text.as_py() or b""


def _key(lang: str, phrase: bytes) -> int:
    return xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass") + b"\0" + phrase, 42)


def _key_column() -> Column:
    """As ``_key``, signed."""
    return F.xxhash64(F.concat(F.col("lang").cast("binary"), F.lit(b"\0"), F.col("phrase")))


def word_counts(docs: DataFrame) -> DataFrame:
    """``lang``, ``phrase`` (one word, binary) and ``f``: how often it occurs in all texts of the language."""
    ship_code(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        found: dict[str, Counter] = {}
        held = 0

        def handed_over() -> Iterator[pa.RecordBatch]:
            for lang, counts in found.items():
                counts.pop(END, None)
                counts.pop(NOTHING, None)
                columns = [pa.array([lang] * len(counts), pa.string()), pa.array(list(counts), pa.binary())]
                columns.append(pa.array(list(counts.values()), pa.int64()))
                yield pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "f"])

        for lang, text in _texts(batches):
            counts = found.setdefault(lang, Counter())
            for some in tokens(text):
                counts.update(some)
            held += len(text)
            if held > HELD_BYTES or len(counts) > HELD_WORDS // 2:
                yield from handed_over()
                found, held = {}, 0
        yield from handed_over()

    return _summed(docs.mapInArrow(counted, "lang string, phrase binary, f long"))


def _summed(counts: DataFrame) -> DataFrame:
    return counts.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def frequent_words(words: DataFrame, min_count: int) -> np.ndarray:
    """A Bloom filter, of a fixed number of bits whatever the vocabulary, that has all words with ``min_count``.

    It only spares work: words that are in it by chance are counted and found to be too rare.
    """
    key = _key_column()
    places = F.array(*(F.pmod(F.shiftrightunsigned(key, 26 * i), F.lit(FILTER_BITS)) for i in range(2)))
    at = words.where(F.col("f") >= min_count).select(F.explode(places).alias("at"))
    bitmap = F.bitmap_construct_agg(F.pmod("at", F.lit(BITMAP_BITS))).alias("bits")
    bits = np.zeros((FILTER_BITS // BITMAP_BITS, BITMAP_BITS // 8), np.uint8)
    for r in at.groupBy(F.floor(F.col("at") / BITMAP_BITS).alias("part")).agg(bitmap).collect():
        bits[r["part"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return bits.reshape(-1)


def in_filter(bits: np.ndarray, lang: str, word: bytes) -> bool:
    key = _key(lang, word)
    for i in range(2):
        at = key >> 26 * i & FILTER_BITS - 1
        if not bits[at >> 3] >> (at & 7) & 1:
            return False
    return True


@dataclass
class Suffixes:
    """Distinct suffixes of two or more frequent words, cut at ``words`` words, with their counts.

    ``rows`` holds numbers of ``vocabulary``, -1 where a suffix has ended, and is sorted.
    """

    vocabulary: list[bytes]
    rows: np.ndarray
    counts: np.ndarray

    def phrase(self, row: np.ndarray) -> bytes:
        return b" ".join([self.vocabulary[i] for i in row])


def sorted_rows(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal rows together, in order. As many columns as fit into 64 bits are sorted as one number."""
    if not len(rows):
        return rows, counts
    bits = int(rows.max() + 1).bit_length()
    at_once = max(64 // max(bits, 1), 1)
    keys = []
    for first in range(0, rows.shape[1], at_once):
        key = np.zeros(len(rows), np.uint64)
        for column in rows.T[first : first + at_once]:
            key = key << np.uint64(bits) | (column + 1).astype(np.uint64)
        keys.append(key)
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(rows), bool)
    new[0] = True
    for key in keys:
        key = key[order]
        new[1:] |= key[1:] != key[:-1]
    first = np.flatnonzero(new)
    return rows[order[first]], np.add.reduceat(counts[order], first)


class _Numbers(dict):
    """Common words have their numbers, other frequent ones are numbered as they come; all others are -1."""

    def __init__(self, lang: str, frequent: np.ndarray, common: Sequence[bytes]):
        super().__init__(zip(common, range(len(common))))
        self[END], self[NOTHING] = -1, -2
        self.lang, self.frequent = lang, frequent
        self.vocabulary = list(common)

    def __missing__(self, word: bytes) -> int:
        number = -1
        if in_filter(self.frequent, self.lang, word):
            number = len(self.vocabulary)
            self.vocabulary.append(word)
        self[word] = number
        return number


class _Held:
    """What a task has read of one language and not handed over."""

    def __init__(self, lang: str, frequent: np.ndarray, common: Sequence[bytes], carried: Sequence[bytes | None] = ()):
        self.numbers = _Numbers(lang, frequent, common)
        self.vocabulary = self.numbers.vocabulary
        self.parts: list[np.ndarray] = []
        self.n = 0
        self.add([END if w is None else w for w in carried])

    def add(self, words: Sequence[bytes]) -> None:
        ids = np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words))
        self.parts.append(ids[ids > -2])
        self.n += len(self.parts[-1])

    def last(self, n: int) -> list[bytes | None]:
        ids = np.concatenate(self.parts)[-n:] if n else []
        return [self.vocabulary[i] if i >= 0 else None for i in ids]

    def suffixes(self, words: int, open_end: bool, starts: Container[tuple[str, bytes]] | None) -> Suffixes:
        """Those of all words, or of all but the last ones if the text goes on; of ``starts`` only, if they are given."""
        ids = np.concatenate([*self.parts, *([] if open_end else [np.full(words - 1, -1, np.int32)])])
        n = max(len(ids) - words + 1, 0)
        # Of single words all is known already.
        wanted = (ids[:n] >= 0) & (ids[1 : n + 1] >= 0)
        if starts is not None:
            wanted &= np.array([(self.numbers.lang, w) in starts for w in self.vocabulary] + [False])[ids[:n]]
        rows = ids[np.flatnonzero(wanted)[:, None] + np.arange(words)]
        for i in range(2, words):
            rows[rows[:, i - 1] < 0, i] = -1
        return Suffixes(self.vocabulary, *sorted_rows(rows, np.ones(len(rows), np.int64)))


def read_suffixes(
    batches: Iterator[pa.RecordBatch],
    frequent: np.ndarray,
    common: Mapping[str, Sequence[bytes]],
    words: int,
    starts: Container[tuple[str, bytes]] | None = None,
) -> Iterator[tuple[str, Suffixes]]:
    """The suffixes of all texts, after so many words or bytes at a time; equal ones may come again.

    With ``starts``, pairs of language and word, only those that begin with one of them.
    """
    held: dict[str, _Held] = {}
    n = size = 0
    for lang, text in _texts(batches):
        for some in tokens(text):
            if (mine := held.get(lang)) is None:
                mine = held[lang] = _Held(lang, frequent, common.get(lang, ()))
            mine.add(some)
            n += len(some)
            size += min(len(text), sum(map(len, some)) if len(some) < 100 else CHUNK)
            if n >= HELD_WORDS or size >= HELD_BYTES:
                carried = mine.last(min(words - 1, mine.n))
                for name, one in held.items():
                    yield name, one.suffixes(words, one is mine, starts)
                held, n, size = {lang: _Held(lang, frequent, common.get(lang, ()), carried)}, 0, 0
        if lang in held:
            held[lang].add([END])
    for name, one in held.items():
        yield name, one.suffixes(words, False, starts)


@dataclass
class Plan:
    """Which prefixes are too frequent for one group, and the group of each bucket of the others.

    ``common`` has the most frequent words of each language in one order for all tasks, so that they need not be sent.
    """

    common: dict[str, list[bytes]]
    heavy: dict[tuple[str, bytes], int] = field(default_factory=dict)
    group_of: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int32))

    def routes(self, lang: str, found: Suffixes) -> Iterator[tuple[int, np.ndarray]]:
        """The rows (as a mask or numbers) of each group: by their first word, or as many as are not too frequent."""
        group = np.full(len(found.rows), -1, np.int32)
        rows, depth = np.arange(len(found.rows)), 1
        while len(rows) and depth <= found.rows.shape[1]:
            some = found.rows[rows, :depth]
            alive = some[:, -1] >= 0
            rows, some = rows[alive], some[alive]
            if not len(rows):
                break
            new = np.concatenate([[True], (some[1:] != some[:-1]).any(axis=1)])
            number = np.cumsum(new) - 1
            of_prefix = np.empty(number[-1] + 1, np.int32)
            for i, prefix in enumerate(some[new]):
                phrase = found.phrase(prefix)
                heavy = (lang, phrase) in self.heavy
                of_prefix[i] = -1 if heavy else self.group_of[_key(lang, phrase) & len(self.group_of) - 1]
            group[rows] = of_prefix[number]
            rows, depth = rows[of_prefix[number] < 0], depth + 1
        order = np.argsort(group, kind="stable")
        edges = np.flatnonzero(np.diff(group[order], prepend=-2))
        for start, to in zip(edges, [*edges[1:], len(order)]):
            if start < to and group[order[start]] >= 0:
                yield int(group[order[start]]), order[start:to]


def first_fit(sizes: Mapping[int, int], budget: int, buckets: int) -> np.ndarray:
    """The group of each bucket: the largest first, each into the first group that has room for it.

    Groups that are open are kept by the room they have left, so that a bucket looks at few of them.
    """
    group_of, open_groups, made = np.zeros(buckets, np.int32), [], 0
    for bucket, size in sorted(sizes.items(), key=lambda s: (-s[1], s[0])):
        for at, (group, left) in enumerate(open_groups):
            if size <= left:
                break
        else:
            at, group, left = len(open_groups), made, budget
            open_groups.append((group, left))
            made += 1
        group_of[bucket] = group
        open_groups[at] = (group, left - size)
        # A group that is nearly full is closed, as are the oldest beyond a number.
        if left - size < budget // 1000 or len(open_groups) > 64:
            del open_groups[at if left - size < budget // 1000 else 0]
    return group_of


def vertical_partitions(
    docs: DataFrame, levels: list[DataFrame], frequent: np.ndarray, words: int, min_count: int, budget: int
) -> Plan:
    """Prefixes of one word, and of one word more as long as they occur more often than ``budget``.

    Each further length is one more pass over the texts, which counts the extensions of the prefixes that are too
    frequent only; ``levels`` gets its counts. The driver sees the prefixes beyond the budget and a sum for each
    bucket of prefixes: both are in number as the words of all texts divided by ``budget``.
    """
    total = sum(r["n"] for r in levels[0].groupBy("lang").agg(F.sum("f").alias("n")).collect())
    buckets = 1 << max(10, (BUCKETS_PER_GROUP * total // budget).bit_length())
    plan, sizes = Plan(common_words(levels[0], min_count)), {}
    for depth in range(1, words + 1):
        counted = levels[-1].where(F.col("f") >= min_count)
        light = counted.where(F.col("f") <= budget).groupBy(F.pmod(_key_column(), F.lit(buckets)).alias("bucket"))
        for r in light.agg(F.sum("f").alias("n")).collect():
            sizes[r["bucket"]] = sizes.get(r["bucket"], 0) + r["n"]
        heavy = {(r["lang"], bytes(r["phrase"])): r["f"] for r in counted.where(F.col("f") > budget).collect()}
        plan.heavy |= heavy
        if not heavy or depth == words:
            break
        some = docs.where(F.col("lang").isin(sorted({lang for lang, _ in heavy})))
        levels.append(stored(_summed(_extensions(some, heavy, frequent, plan.common, depth + 1)), "prefixes"))
    plan.group_of = first_fit(sizes, budget, buckets)
    return plan


def common_words(words: DataFrame, min_count: int) -> dict[str, list[bytes]]:
    """At most ``COMMON_WORDS`` of the most frequent words, by language and frequency."""
    found: dict[str, list[bytes]] = {}
    best = words.where(F.col("f") >= min_count).orderBy(F.desc("f"), "lang", "phrase").limit(COMMON_WORDS)
    for r in best.collect():
        found.setdefault(r["lang"], []).append(bytes(r["phrase"]))
    return found


def _extensions(docs: DataFrame, heavy: Mapping, frequent: np.ndarray, common: Mapping, length: int) -> DataFrame:
    starts = set(heavy)
    first_words = {(lang, phrase.split(b" ")[0]) for lang, phrase in heavy}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, found in read_suffixes(batches, frequent, common, length, first_words):
            whole = found.rows[:, -1] >= 0
            rows, counts = found.rows[whole], found.counts[whole]
            if not len(rows):
                continue
            new = np.concatenate([[True], (rows[1:, :-1] != rows[:-1, :-1]).any(axis=1)])
            wanted = np.array([(lang, found.phrase(r[:-1])) in starts for r in rows[new]])[np.cumsum(new) - 1]
            phrases = [found.phrase(r) for r in rows[wanted]]
            columns = [pa.array([lang] * len(phrases), pa.string()), pa.array(phrases, pa.binary())]
            columns.append(pa.array(counts[wanted], pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "f"])

    return docs.mapInArrow(counted, "lang string, phrase binary, f long")


def pack(numbers: np.ndarray) -> bytes:
    """Numbers column by column, of all first the low bytes, so that what is alike lies together, and compressed."""
    planes = np.ascontiguousarray(numbers.T.astype("<u4")).view(np.uint8).reshape(-1, 4).T
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes, rows: int, columns: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, rows * columns * 4, codec="zstd"), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(columns, rows).T


def dealt_suffixes(docs: DataFrame, plan: Plan, frequent: np.ndarray, words: int) -> DataFrame:
    """A row for each hand-over, language and group: the suffixes with those of their words that are not common."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, found in read_suffixes(batches, frequent, plan.common, words):
            out = []
            for group, at in plan.routes(lang, found):
                rows = found.rows[at]
                used = np.zeros(len(found.vocabulary) + 1, bool)
                used[rows] = True
                n = len(plan.common.get(lang, ()))
                used[:n], used[-1] = True, False
                rows = np.append(np.cumsum(used[:-1]), 0)[rows]
                used[:n] = False
                out.append(
                    {
                        "group": group,
                        "lang": lang,
                        "vocabulary": b" ".join([found.vocabulary[i] for i in np.flatnonzero(used)]),
                        "suffixes": pack(rows),
                        "counts": pack(found.counts[at]),
                        "n": len(rows),
                    }
                )
            if out:
                kinds = [pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.int32()]
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema(list(zip(out[0], kinds))))

    return docs.mapInArrow(dealt, "group int, lang string, vocabulary binary, suffixes binary, counts binary, n int")


def subtree_counts(found: Suffixes, min_count: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each depth the nodes with ``min_count`` occurrences: their rows and how many leaves they have below them.

    The sorted suffixes are the leaves in the order of the subtree, so a node is a stretch of rows with one prefix.
    """
    rows, counts = found.rows, found.counts
    new = np.zeros(len(rows), bool)
    if len(rows):
        new[0] = True
    for depth in range(1, rows.shape[1] + 1):
        new[1:] |= rows[1:, depth - 1] != rows[:-1, depth - 1]
        first = np.flatnonzero(new)
        if not len(first):
            return
        total = np.add.reduceat(counts, first)
        node = (rows[first, depth - 1] >= 0) & (total >= min_count)
        yield depth, rows[first[node], :depth], total[node]


def _merged(parts: Iterator[tuple[bytes, bytes, bytes, int]], words: int, common: Sequence[bytes]) -> Suffixes:
    known = dict(zip(common, range(len(common))))
    rows, totals = [], []
    for vocabulary, packed, counts, n in parts:
        fresh = [known.setdefault(w, len(known)) for w in vocabulary.split(b" ") if w]
        ids = np.concatenate([np.arange(-1, len(common), dtype=np.int32), np.array(fresh, np.int32)])
        rows.append(ids[unpack(packed, n, words)])
        totals.append(unpack(counts, n, 1)[:, 0].astype(np.int64))
    return Suffixes(list(known), *sorted_rows(np.concatenate(rows), np.concatenate(totals)))


def phrase_counts(
    docs: DataFrame, *, words: int = WORDS, min_count: int = MIN_COUNT, budget: int = GROUP_SUFFIXES
) -> tuple[DataFrame, DataFrame]:
    """Phrases of up to ``words`` words that occur at least ``min_count`` times, and the words of each language.

    ``docs`` has ``lang`` and ``text``, no nulls in ``lang``. Returns ``lang``, ``phrase`` (binary, joined by spaces),
    ``words``, ``f``, and ``lang``, ``n``. Prefixes are grouped so that a group has at most ``budget`` suffixes;
    each group's subtrees are built by one task, independently of the others. Tasks get the most frequent words as a list,
    at most ``COMMON_WORDS``. The counts of single words, and of prefixes
    that are spread over several groups, are those that the groups were made by.
    """
    ship_code(docs.sparkSession)
    levels = [stored(word_counts(docs), "words")]
    totals = levels[0].groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = frequent_words(levels[0], min_count)
    plan = vertical_partitions(docs, levels, frequent, words, min_count, budget)
    heavy = plan.heavy

    def counted(table: pa.Table) -> pa.Table:
        out: dict[str, list] = {"lang": [], "phrase": [], "words": [], "f": []}
        langs = table.column("lang").to_pylist()
        for lang in sorted(set(langs)):
            at = [i for i, name in enumerate(langs) if name == lang]
            columns = [table.column(c) for c in ("vocabulary", "suffixes", "counts", "n")]
            found = _merged((tuple(c[i].as_py() for c in columns) for i in at), words, plan.common.get(lang, ()))
            for depth, rows, totals in subtree_counts(found, min_count):
                for row, total in zip(rows, totals.tolist()):
                    phrase = found.phrase(row)
                    # Such a node has leaves in other groups; its count is known from the passes before.
                    if depth > 1 and (lang, phrase) not in heavy:
                        for c, v in zip(out, (lang, phrase, depth, total)):
                            out[c].append(v)
        kinds = [pa.string(), pa.binary(), pa.int32(), pa.int64()]
        return pa.table([pa.array(v, k) for v, k in zip(out.values(), kinds)], names=list(out))

    dealt = dealt_suffixes(docs, plan, frequent, words)
    found = dealt.groupBy("group").applyInArrow(counted, "lang string, phrase binary, words int, f long")
    for depth, level in enumerate(levels, 1):
        known = level.where(F.col("f") >= (min_count if depth == 1 else max(budget + 1, min_count)))
        found = found.unionByName(known.select("lang", "phrase", F.lit(depth).alias("words"), "f"))
    return stored(found, "phrases"), stored(totals, "word-totals")


def _cut_scores(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """Candidates with their lowest-scoring cut."""
    exact = "decimal(38,0)"
    several = phrases.where("words > 1").withColumn("parts", F.split(F.col("phrase").cast("string"), " "))
    cuts = several.select("lang", "phrase", "words", F.col("f").alias("a"), "parts", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    left = F.array_join(F.slice("parts", F.lit(1), F.col("k")), " ").cast("binary")
    right = F.array_join(F.slice("parts", F.col("k") + 1, F.col("words") - F.col("k")), " ").cast("binary")
    cuts = cuts.select("lang", "phrase", "words", "a", "k", left.alias("left"), right.alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        counted = phrases.select("lang", F.col("phrase").alias(side), F.col("f").alias(name))
        cuts = cuts.join(counted, ["lang", side])
    cuts = cuts.join(totals, "lang")
    above = F.lit(1000).cast(exact) * F.col("a").cast(exact) * F.col("n").cast(exact)
    below = F.col("l").cast(exact) * F.col("r").cast(exact)
    cuts = cuts.withColumn("above", above).withColumn("below", below).withColumn("score", F.expr("above div below"))
    cut = F.min(F.struct("score", "k", "l", "r", "n")).alias("cut")
    return cuts.groupBy("lang", "phrase", "words", "a").agg(cut).select("lang", "phrase", "words", "a", "cut.*")


def collocations(
    docs: DataFrame,
    *,
    text: str = "text",
    lang: str = "lang",
    words: int = WORDS,
    min_count: int = MIN_COUNT,
    top: int = TOP,
    budget: int = GROUP_SUFFIXES,
) -> DataFrame:
    """The best ``top`` phrases of each language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    A phrase of 2 to ``words`` words that occurs a >= ``min_count`` times scores floor(1000 a n / (l r)), n the words of
    its language, l and r the counts of the two parts of its lowest-scoring cut, ties by the shortest first part. One that a longer
    candidate contains, and that occurs no more often than it, is dropped. Ties in score go by a, then by phrase.

    A null text has no words, a null language is ``und``; repeated rows count each time. Texts are read whole, and in
    parts where they are long. Tables without rows, or without frequent phrases, give no rows. Other columns are not read.
    """
    name = F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN))
    read = docs.where(F.col(text).isNotNull()).select(name.alias("lang"), F.col(text).alias("text"))
    phrases, totals = phrase_counts(read, words=words, min_count=min_count, budget=budget)
    scored = _cut_scores(phrases, totals)
    # A phrase inside a longer one as frequent is also inside one that is longer by a word and as frequent.
    longer = phrases.where("words > 2").withColumn("parts", F.split(F.col("phrase").cast("string"), " "))
    inner = F.array(*(F.array_join(F.slice("parts", F.lit(i), F.col("words") - 1), " ").cast("binary") for i in (1, 2)))
    inner = longer.select("lang", F.col("f").alias("a"), F.explode(inner).alias("phrase")).distinct()
    left = scored.join(inner, ["lang", "phrase", "a"], "left_anti")
    # A language's phrases are ranked in slices first, so that the last task sees at most so many of each slice.
    best = [F.desc("score"), F.desc("a"), "phrase"]
    sliced = left.withColumn("_slice", F.pmod(F.xxhash64("phrase"), F.lit(SLICES)))
    within = F.row_number().over(Window.partitionBy("lang", "_slice").orderBy(*best))
    some = sliced.withColumn("rank", within).where(F.col("rank") <= top).drop("rank", "_slice")
    order = Window.partitionBy("lang").orderBy(*best)
    ranked = some.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    phrase = F.col("phrase").cast("string").alias("phrase")
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), phrase, "a", "l", "r", "n", "score")
