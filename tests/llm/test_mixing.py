import random
from collections import Counter
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from plain import no_documents, odd_documents, odd_rows

from starboard.llm.mixing import Ideal, blocks_before, exact, mix_sources, stretch


@pytest.mark.parametrize("weights", [{"a": 1, "b": 1}, {}, {"a": 0, "b": 1, "c": 1}])
def test_weights_that_do_not_fit_are_errors(spark, weights):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "doc_id long, source string")
    with pytest.raises(ValueError):
        mix_sources(docs, weights=weights)


def test_slots_of_rows_against_the_schedule(spark, monkeypatch):
    import starboard.llm.mixing as mixing

    monkeypatch.setattr(mixing, "CHUNK_ROWS", 50)
    sizes = {"hot": 1000, "b": 300, "c": 33, None: 70}
    weights = {"hot": 0.4, "b": 0.3, "c": 0.2, None: 0.1}
    names = [s for s, n in sizes.items() for _ in range(n)]
    docs = spark.createDataFrame(list(enumerate(names)), "doc_id long, source string").repartition(5)
    found = mix_sources(docs, weights=weights, block_rows=8).collect()
    assert sorted(r["doc_id"] for r in found) == list(range(len(names)))
    assert all(names[r["doc_id"]] == r["source"] for r in found)
    slots = {r["slot"]: (r["source"], r["block"]) for r in found}
    assert [slots[t] for t in sorted(slots)] == list(exact({s: -(-n // 8) for s, n in sizes.items()}, weights))
    assert sorted(slots) == list(range(len(slots)))
    places = Counter((r["slot"], r["place"]) for r in found)
    assert max(places.values()) == 1 and all(p < 8 for _, p in places)
    assert {s: sum(r["source"] == s for r in found) for s in sizes} == sizes


def test_a_second_run_gives_the_same_and_another_seed_another_mix(spark):
    docs = spark.createDataFrame([(i, f"s{i % 3}") for i in range(900)], "doc_id long, source string")
    first = sorted(map(tuple, mix_sources(docs).collect()))
    assert sorted(map(tuple, mix_sources(docs.repartition(3)).collect())) == first
    assert sorted(map(tuple, mix_sources(docs, seed=1).collect())) != first


def test_rows_without_an_id_are_spread(spark, tmp_path, monkeypatch):
    import starboard.llm.mixing as mixing

    monkeypatch.setattr(mixing, "CHUNK_ROWS", 50)
    path = str(tmp_path / "docs")
    spark.range(3000).selectExpr("IF(id % 3 = 0, NULL, id) AS doc_id", "'s' AS source").repartition(4).write.parquet(path)
    found = mix_sources(spark.read.parquet(path), block_rows=100).collect()
    assert sum(r["doc_id"] is None for r in found) == 1000
    by_slot = Counter(r["slot"] for r in found if r["doc_id"] is None)
    assert len(by_slot) == 30 and max(by_slot.values()) < 60


def test_the_order_can_follow_other_columns(spark):
    docs = spark.createDataFrame([(i, f"t{i}", f"s{i % 3}") for i in range(600)], "doc_id long, text string, source string")
    first = {r["text"]: r["slot"] for r in mix_sources(docs, carry=("text",), by=("text",)).collect()}
    again = mix_sources(docs.selectExpr("doc_id + 7 AS doc_id", "text", "source"), carry=("doc_id", "text"), by=("text",))
    assert {r["text"]: r["slot"] for r in again.collect()} == first


def test_odd_and_no_documents(spark):
    found = mix_sources(odd_documents(spark)).collect()
    assert Counter((r["doc_id"], r["source"]) for r in found) == Counter((r[0], r[3]) for r in odd_rows())
    assert mix_sources(no_documents(spark)).collect() == []


def ideal(blocks, weights, slots):
    """Blocks that each source has had after each number of slots if all flow at once by their weights."""
    had, out, t = dict.fromkeys(blocks, Fraction(0)), [], Fraction(0)
    for until in range(1, slots + 1):
        while t < until:
            active = [s for s in blocks if had[s] < blocks[s]]
            total = sum(Fraction(weights[s]) for s in active)
            step = min([until - t] + [(blocks[s] - had[s]) * total / Fraction(weights[s]) for s in active])
            for s in active:
                had[s] += step * Fraction(weights[s]) / total
            t += step
        out.append(dict(had))
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.floats(1e-4, 100), st.integers(1, 40)), min_size=1, max_size=12))
def test_less_than_one_block_from_the_given_weights_over_the_whole_mix(sources):
    weights, blocks = ({f"s{i}": x[k] for i, x in enumerate(sources)} for k in (0, 1))
    had, order = Counter(), list(exact(blocks, weights))
    for (s, i), want in zip(order, ideal(blocks, weights, len(order)), strict=True):
        assert i == had[s]
        had[s] += 1
        assert all(abs(had[x] - want[x]) < 1 for x in blocks)
    assert had == blocks


def test_less_than_one_block_from_the_given_weights_after_many_blocks():
    sizes = {"hot": 1_000_000} | {f"s{i}": 105_000 + 480 * i for i in range(19)}
    weights = {s: n**0.5 for s, n in sizes.items()} | {"rare": 0.02}
    total, had = sum(weights.values()), Counter()
    assert weights["rare"] / total < 1 / 100_000
    order = exact({s: -(-n // 64) for s, n in sizes.items()} | {"rare": 10}, weights)
    for t, (s, i) in enumerate(order, 1):
        assert i == had[s]
        had[s] += 1
        if t <= 30_000 and (t % 97 == 0 or t > 29_000):
            assert all(abs(had[x] - t * w / total) < 1 + 1e-6 for x, w in weights.items())
    assert had["hot"] == 15_625 and had["rare"] == 10


def test_more_sources_than_a_period_had_parts(spark):
    docs = spark.range(4500).selectExpr("id AS doc_id", "concat('s', id % 1500) AS source")
    found = mix_sources(docs, block_rows=2).collect()
    assert sorted(r["doc_id"] for r in found) == list(range(4500))
    assert {r["slot"] for r in found} == set(range(3000))
    firsts = [r["block"] for r in sorted(found, key=lambda r: (r["slot"], r["place"]))[:3000]]
    assert set(firsts) == {0}


def in_stretches(blocks, weights, slots):
    """The mix cut every ``slots`` slots, each stretch scheduled by itself."""
    ideal = Ideal(blocks, weights)
    before = dict.fromkeys(ideal.count, 0)
    for first in range(0, ideal.slots, slots):
        end = min(first + slots, ideal.slots)
        through = blocks_before(ideal, end)
        assert sum(through.values()) == end
        yield from stretch(ideal, first, before, end, through)
        before = through


@settings(max_examples=150, deadline=None)
@given(
    st.lists(st.tuples(st.integers(1, 60), st.one_of(st.integers(1, 9), st.floats(0.01, 100))), min_size=1, max_size=9),
    st.integers(1, 50),
)
def test_less_than_one_block_from_the_weights_across_cuts(sources, slots):
    blocks = {f"s{i}": n for i, (n, _) in enumerate(sources)}
    weights = {f"s{i}": w for i, (_, w) in enumerate(sources)}
    found = list(in_stretches(blocks, weights, slots))
    had, shares = Counter(), ideal(blocks, weights, len(found))
    for (s, i), share in zip(found, shares):
        assert i == had[s]
        had[s] += 1
        assert all(abs(had[x] - share[x]) < 1 for x in blocks)
    assert had == blocks


def test_cuts_with_very_many_sources():
    dice = random.Random(1)
    blocks = {f"s{i}": dice.randrange(1, 4) for i in range(1500)} | {"hot": 4000}
    weights = {s: n**0.5 for s, n in blocks.items()}
    whole = Ideal(blocks, weights)
    edge = whole.slots // 2
    before = blocks_before(whole, edge)
    left = Counter(s for s, _ in stretch(whole, 0, dict.fromkeys(blocks, 0), edge, before))
    right = Counter(s for s, _ in stretch(whole, edge, before, whole.slots, blocks))
    assert left + right == Counter(blocks)
    for s, (full, part) in whole.had(edge).items():
        assert full <= before[s] <= full + part


def test_stretches_of_rows(spark):
    """The same rows in one stretch and in many: every row once, each stretch its slots."""
    sizes = {"hot": 3000, "b": 700, "c": 90, None: 40}
    names = [s for s, n in sizes.items() for _ in range(n)]
    docs = spark.createDataFrame(list(enumerate(names)), "doc_id long, source string")
    found = mix_sources(docs, block_rows=4, stretch_slots=37).collect()
    assert sorted(r["doc_id"] for r in found) == list(range(len(names)))
    blocks = {s: -(-n // 4) for s, n in sizes.items()}
    slots = {r["slot"]: (r["source"], r["block"]) for r in found}
    assert [slots[t] for t in sorted(slots)] == list(in_stretches(blocks, {s: float(n) ** 0.5 for s, n in sizes.items()}, 37))
