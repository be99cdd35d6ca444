import math
from collections import Counter

import numpy as np
import pytest
from plain import no_documents, odd_documents, odd_rows

from starboard.llm.importance import HashedNgrams, importance_sample

BUCKETS = 512


def weights(rows, targets):
    features, raw, target = HashedNgrams(), np.zeros(BUCKETS), np.zeros(BUCKETS)
    counts = []
    for r in rows:
        found = np.zeros(BUCKETS)
        for b in features.buckets(r[1], BUCKETS).tolist():
            found[int(b)] += 1
        counts.append(found)
        raw += found
        target += found * (r[0] in targets)
    p, q = (target + 1) / (target.sum() + BUCKETS), (raw + 1) / (raw.sum() + BUCKETS)
    return [float((c * np.log(p / q)).sum()) for c in counts]


@pytest.mark.parametrize("n", [0, 1, 9, 1000])
def test_weights_and_positions(spark, n):
    targets = spark.createDataFrame([(0,), (1,), (12,), (None,), (12,), (777,)], "doc_id long")
    found = importance_sample(odd_documents(spark).repartition(3), targets, sample_rows=n, buckets=BUCKETS).collect()
    rows = odd_rows()
    want = sorted((str(r[0]), round(w, 6)) for r, w in zip(rows, weights(rows, {0, 1, 12})))
    assert sorted((str(r["doc_id"]), round(r["log_weight"], 6)) for r in found) == want
    found.sort(key=lambda r: r["position"])
    assert [r["position"] for r in found] == list(range(len(rows)))
    assert all(a["sample_key"] >= b["sample_key"] for a, b in zip(found, found[1:]))
    assert [r["selected"] for r in found] == [i < n for i in range(len(rows))]
    assert all(r["log_weight"] == 0 for r, in zip(found) if r["doc_id"] in (2, 3, 4))


def test_words_and_pairs():
    features = HashedNgrams()
    assert len(features.buckets("a b, c", 1 << 30)) == 4 + 3 and len(features.buckets(None, 8)) == 0
    assert features.buckets("a b", 1 << 30).tolist() != features.buckets("b a", 1 << 30).tolist()


def test_samples_follow_the_weights(spark):
    rows = [(i, "good " * 2 if i % 2 else "bad " * 2) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    targets = spark.createDataFrame([(i,) for i in range(1, 2000, 2)] + [(0,), (2,)], "doc_id long")
    found = importance_sample(docs, targets, sample_rows=400, buckets=1 << 16).collect()
    by = {r["doc_id"] % 2: r["log_weight"] for r in found}
    odds = math.exp(by[1] - by[0])
    taken = Counter(r["doc_id"] % 2 for r in found if r["selected"])
    assert odds > 5 and taken[1] > 0.9 * 400
    # the noise is that of a Gumbel distribution: mean 0.577, variance pi^2 / 6
    noise = np.array([r["sample_key"] - r["log_weight"] for r in found])
    assert noise.mean() == pytest.approx(0.5772, abs=0.08) and noise.var() == pytest.approx(1.645, abs=0.25)


def test_quality_of_labelled_documents(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    fit = labels.where("quality = 1 AND doc_id % 2 = 0").select("doc_id")
    found = importance_sample(spark.read.parquet(f"{sf}/documents.parquet"), fit, sample_share=0.85)
    held = found.join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    kept = {q: np.mean([r["selected"] for r in held if r["quality"] == q]) for q in (0, 1)}
    assert kept[1] > 0.95 and kept[0] < 0.5


def test_without_targets_and_without_rows(spark):
    none = spark.createDataFrame([], "doc_id long")
    assert {r["log_weight"] for r in importance_sample(odd_documents(spark), none).collect()} == {0.0}
    assert importance_sample(no_documents(spark), none).collect() == []


@pytest.mark.parametrize("one_id", [7, None])
def test_rows_with_one_id_have_noise_of_their_own(spark, tmp_path, one_id):
    path = str(tmp_path / "docs")
    rows = [(one_id, "good " * (i % 2 + 1)) for i in range(2000)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(path)
    none = spark.createDataFrame([], "doc_id long")
    first, again = (importance_sample(spark.read.parquet(path), none, sample_rows=400).collect() for _ in range(2))
    noise = np.array([r["sample_key"] - r["log_weight"] for r in first])
    assert len(set(noise.round(12).tolist())) == 2000
    assert noise.mean() == pytest.approx(0.5772, abs=0.12) and noise.var() == pytest.approx(1.645, abs=0.35)
    assert sorted(r["sample_key"] for r in first) == sorted(r["sample_key"] for r in again)


def test_the_sample_does_not_follow_the_files(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(docs.limit(50)).unionByName(docs.selectExpr("CAST(NULL AS LONG) AS doc_id", "text").limit(60))
    targets = docs.where("doc_id % 5 = 0").select("doc_id")
    shown = []
    for name, files in (("a", 2), ("b", 6)):
        docs.repartition(files).write.parquet(f"{tmp_path}/{name}")
        found = importance_sample(spark.read.parquet(f"{tmp_path}/{name}"), targets, sample_rows=100).collect()
        shown.append([(r["position"], r["doc_id"], round(r["sample_key"], 9), r["selected"]) for r in sorted(found, key=lambda r: r["position"])])
    assert shown[0] == shown[1]
