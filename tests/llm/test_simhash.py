import random

import numpy as np
import pytest
from plain import components, fingerprint, no_documents, odd_documents, odd_rows

from starboard.llm import simhash


def signed(value):
    return value - (1 << 64) if value >> 63 else value


def test_fingerprints_of_odd_texts():
    for r in odd_rows():
        if len(r[1] or "") < 1000:
            assert simhash.text_fingerprint(r[1], 3) == signed(fingerprint(r[1]))


def test_a_text_longer_than_one_chunk():
    text = " ".join(str(i % 977) for i in range(70_000))
    assert simhash.text_fingerprint(text, 3) == signed(fingerprint(text))


def test_components_of_odd_documents(spark):
    rows = sorted(odd_rows(), key=lambda r: (r[0] is None, r[0] or 0))
    docs = odd_documents(spark)
    want = components([fingerprint(r[1]) for r in rows])
    found = simhash.simhash_components(docs).collect()
    found.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    assert [r["first"]["doc_id"] for r in found] == [rows[i][0] for i in want]


@pytest.mark.parametrize("distance", [0, 1, 2, 3, 4])
@pytest.mark.parametrize("pairwise", [2, 1000])
def test_links_of_random_and_clustered_fingerprints(spark, monkeypatch, distance, pairwise):
    monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
    dice = random.Random(distance)
    values = {dice.getrandbits(64) for _ in range(150)}
    for _ in range(3):
        center = dice.getrandbits(64)
        for _ in range(60):
            values.add(center ^ sum({1 << dice.randrange(64) for _ in range(dice.randrange(1, 5))}))
    values = sorted(map(signed, values))
    prints = spark.createDataFrame([(v,) for v in values], "f long")
    linked = simhash.connected_components(simhash.near_links(prints, "f", distance), "a", "b")
    got = {r["node"]: r["root"] for r in linked.collect()}
    want = components([v & (1 << 64) - 1 for v in values], distance)
    assert [got.get(v, v) for v in values] == [values[i] for i in want]


def test_thresholds_are_the_cheapest_that_add_up():
    dice = random.Random(1)
    costs = [[0.0, *sorted(dice.random() * 10 for _ in range(4))] for _ in range(4)]
    best = min(
        sum(costs[i][t + 1] for i, t in enumerate(ts))
        for ts in np.ndindex(5, 5, 5, 5)
        if sum(ts) - 4 == 3 - 4 + 1
        for ts in [[t - 1 for t in ts]]
    )
    cost, thresholds = simhash.allocate(costs, 3 - 4 + 1)
    assert sum(thresholds) == 0 and cost == pytest.approx(best)


def test_correlated_bits_go_together():
    dice = np.random.default_rng(0)
    base = dice.integers(0, 2, (4000, 8))
    bits = np.repeat(base, 8, axis=1)[:, dice.permutation(64)]
    bits = bits ^ (dice.random(bits.shape) < 0.05)
    groups = simhash.correlated_partitions(len(bits), bits.T @ bits, 8)
    assert sorted(b for g in groups for b in g) == list(range(64))
    rho = np.corrcoef(bits.T)
    assert all(rho[a, b] > 0.5 for g in groups for a in g for b in g)


def test_no_documents(spark):
    assert simhash.simhash_components(no_documents(spark)).collect() == []
