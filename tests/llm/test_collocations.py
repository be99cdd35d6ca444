"""Collocations against plain Python, with budgets small enough for prefixes of every length."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from plain import no_documents, odd_documents, odd_rows

from starboard.llm import collocations as c


def plain(rows, min_count, top=2000, words=5):
    counts, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            found = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(found)
            for k in range(1, words + 1):
                counts[lang].update(" ".join(found[i : i + k]) for i in range(len(found) - k + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if a >= min_count and " " in p}
        best = []
        for p, a in candidates.items():
            parts = p.split(" ")
            if any(f" {p} " in f" {q} " and q != p and b >= a for q, b in candidates.items()):
                continue
            cuts = [(f[" ".join(parts[:k])], f[" ".join(parts[k:])], k) for k in range(1, len(parts))]
            score, _, left, right = min((1000 * a * n[lang] // (left * right), k, left, right) for left, right, k in cuts)
            best.append((-score, -a, p.encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def texts(dice, n):
    names = ["the", "a", "x", "\x01y", "Über", "B", "c1", "it's", "b b"]
    ends = [" ", " ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", " ; "]
    weights = [8, 4, 3, 2, 1, 2, 1, 1, 1]
    return [("".join(dice.choices(names, weights)[0] + dice.choice(ends) for _ in range(dice.randrange(60))), dice.choice(["en", "de", None, "und"])) for _ in range(n)]


@pytest.mark.parametrize("budget", [5, 40, 400, 10**6])
def test_against_plain_python(spark, monkeypatch, budget):
    monkeypatch.setattr(c, "COMMON_WORDS", 7)
    rows = texts(random.Random(budget), 300) + [(None, "en"), ("", "de"), ("one two three four five six " * 30, "fr")]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    want = plain(rows, 5, top=150)
    found = c.collocations(docs, min_count=5, top=150, budget=budget)
    assert sorted(map(tuple, found.collect())) == want
    assert len(want) > 100


def test_suffixes_do_not_depend_on_where_they_are_handed_over(monkeypatch):
    import pyarrow as pa

    rows = texts(random.Random(3), 60)
    batch = pa.RecordBatch.from_pydict({"lang": [lang or "und" for _, lang in rows], "text": [t for t, _ in rows]})
    everything = np.full(c.FILTER_BITS // 8, 255, np.uint8)

    def counted():
        out = Counter()
        for lang, found in c.read_suffixes(iter([batch]), everything, {"en": [b"x", b"the"]}, 4):
            for row, n in zip(found.rows, found.counts.tolist()):
                out[lang, found.phrase(row[row >= 0])] += n
        return out

    want = counted()
    for held, chunk in ((7, 5), (40, 50), (1, 1)):
        monkeypatch.setattr(c, "HELD_WORDS", held)
        monkeypatch.setattr(c, "CHUNK", chunk)
        assert counted() == want


def test_long_texts(spark):
    """A text without a space, and one of many words without the end of a piece."""
    rows = [("x" * 5_000_000, "en"), ("p q r " * 700_000, "en")]
    found = c.collocations(spark.createDataFrame(rows, "text string, lang string"), top=3).collect()
    first = 1000 * 2_100_001 // 700_000
    assert [(r["phrase"], r["a"], r["n"], r["score"]) for r in found] == [("p q r", 700_000, 2_100_001, first)] + [
        (p, 699_999, 2_100_001, 1000 * 699_999 * 2_100_001 // 700_000**2) for p in ("p q r p q", "q r p q r")
    ]


def test_odd_rows_and_no_rows(spark):
    rows = [(r[1], r[2]) for r in odd_rows()]
    found = c.collocations(odd_documents(spark), min_count=10)
    assert sorted(map(tuple, found.collect())) == plain(rows, 10)
    assert c.collocations(no_documents(spark)).collect() == []


def test_exact_beyond_64_bits(spark):
    counted = spark.createDataFrame([("x", b"a b", 2, 3 * 10**12), ("x", b"a", 1, 7 * 10**12), ("x", b"b", 1, 9 * 10**12)], "lang string, phrase binary, words int, f long")
    totals = spark.createDataFrame([("x", 9 * 10**15)], "lang string, n long")
    (row,) = c._cut_scores(counted, totals).collect()
    assert row["score"] == 1000 * 3 * 10**12 * 9 * 10**15 // (63 * 10**24)


def test_rows_packed_and_back():
    rows = np.array([[0, 5, -1], [70_000, 1 << 24, 3]], np.int32)
    assert (c.unpack(c.pack(rows + 1), 2, 3).astype(int) - 1 == rows).all()


def test_groups_keep_the_budget():
    sizes = {i: (i * 37) % 100 + 1 for i in range(1000)}
    groups = c.first_fit(sizes, 100, 1024)
    filled = Counter()
    for bucket, size in sizes.items():
        filled[groups[bucket]] += size
    assert max(filled.values()) <= 100 and len(filled) < 1.2 * sum(sizes.values()) / 100
