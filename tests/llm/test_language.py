import zlib
from collections import Counter

import numpy as np
import pytest
from plain import no_documents, odd_documents, odd_rows

from starboard.llm.language import Profiles, identify_languages, learn_profiles, ngrams


def plain_grams(text):
    out = Counter()
    for word in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split():
        out.update(word)
        padded = f" {word} "
        for n in (2, 3):
            out.update(g for i in range(len(padded) - n + 1) if " " not in (g := padded[i : i + n])[1:-1])
    return out


def code(gram):
    value = 0
    for c in gram:
        value = value << 21 | ord(c)
    return value


@pytest.mark.parametrize("text", [None, "", "123 --", "A", "The cat, the DOG; 7 öfen", "中文 and é", "x" * 1000])
def test_ngrams(text):
    want = Counter({code(g): n for g, n in plain_grams(text).items()})
    assert Counter(ngrams(text).tolist()) == want


def ranked(counts, size):
    return [g for g, _ in sorted(((code(g), n) for g, n in counts.items()), key=lambda x: (-x[1], x[0]))][:size]


def test_profiles_and_distances_against_plain_python(spark):
    docs = odd_documents(spark).repartition(4)
    profiles = learn_profiles(docs, size=50)
    totals = {}
    for r in odd_rows():
        if r[2]:
            totals.setdefault(r[2], Counter()).update(plain_grams(r[1]))
    assert {n: p.tolist() for n, p in profiles.items()} == {n: ranked(c, 50) for n, c in totals.items()}
    known = Profiles(profiles, 50)
    for r in odd_rows():
        own = ranked(plain_grams(r[1]), 50)
        if not own:
            assert known.best(r[1]) == ("und", 0.0)
            continue
        apart = []
        for name in sorted(profiles):
            place = {g: i for i, g in enumerate(profiles[name].tolist())}
            apart.append((sum(abs(i - place[g]) if g in place else 50 for i, g in enumerate(own)), name))
        assert known.best(r[1]) == (min(apart)[1], pytest.approx(1 - min(apart)[0] / (50 * len(own))))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = identify_languages(docs).where("language.held_out").select("lang", "language.*").collect()
    assert len(found) > 200 and np.mean([r["lang"] == r["lang_pred"] for r in found]) > 0.98


def test_odd_documents(spark):
    found = identify_languages(odd_documents(spark)).collect()
    texts = Counter((r["doc_id"], r["text"], r["Score"]) for r in found)
    assert texts == Counter((r[0], r[1], r[6]) for r in odd_rows())
    for r in found:
        assert r["language"]["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["language"]["score"] <= 1
        assert (r["language"]["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or ""))


def test_without_labels_and_without_rows(spark):
    docs = odd_documents(spark).selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")
    assert {r["language"]["lang_pred"] for r in identify_languages(docs).collect()} == {"und"}
    assert identify_languages(no_documents(spark)).collect() == []
