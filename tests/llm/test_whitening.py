"""Whitening against numpy's eigenvectors and exact integers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from starboard.llm import whitening as w
from starboard.llm.queries import QUERIES

FIELDS = "vec_id long, embedding array<float>, label int"


def table(spark, rows):
    return spark.createDataFrame(rows, FIELDS)


def directions_agree(r, values, vectors):
    d = r.shape[1]
    want = np.linalg.svd(r, compute_uv=False)
    assert np.allclose(np.sqrt(values), want[: len(values)], rtol=1e-13 * d, atol=want[0] * 1e-15 * d)
    want = want**2
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-9
    rest = r.T @ (r @ vectors) - vectors * values
    assert np.abs(rest).max() <= 1e-12 * d * max(want[0], 1e-300)


@pytest.mark.parametrize("d", [1, 2, 3, 7, 32, 64, 130])
def test_singular_values_and_vectors_of_random_matrices(d):
    dice = np.random.default_rng(d)
    for spread in (0, 1, 4):
        r = np.triu(dice.normal(size=(d, d))) @ np.diag(10.0 ** -dice.uniform(0, spread + 1e-9, d))
        directions_agree(r, *w.right_vectors(r, d if spread < 4 else max(1, d // 2)))


def orthogonal(dice, d):
    return np.linalg.qr(dice.normal(size=(d, d)))[0]


@pytest.mark.parametrize(
    "values",
    [
        [1.0] * 8,
        [3.0, 3.0, 3.0, 1.0, 1.0, 1.0],
        [2.0, 2.0 - 1e-12, 2.0 - 2e-12, 1.0, 1.0 - 1e-9, 1e-3],
        [5.0, 4.0, 3.0, 0.0, 0.0, 0.0],
        [1.0] + [1e-5] * 9,
        [1.0, 0.5] + [1.0 - 1e-4 * i for i in range(1, 30)],
    ],
)
def test_equal_close_and_zero_values(values):
    dice = np.random.default_rng(1)
    d = len(values)
    for outer in (np.eye(d), orthogonal(dice, d)):
        r = np.linalg.qr(orthogonal(dice, d) @ np.diag(values) @ outer, mode="r") if outer[0, 0] != 1 else np.diag(values)
        found, vectors = w.right_vectors(r, d)
        assert len(found) == sum(v > 0 for v in values)
        directions_agree(r, found, vectors)


def test_dqds_keeps_tiny_values_relatively_accurate():
    # The squares of the singular values of this matrix have the product of the squared diagonal.
    diagonal, upper = [1.0, 1e-4, 1e-8, 1e-12], [1.0, 1e-4, 1e-8]
    found = w.dqds(diagonal, upper)
    assert np.isclose(np.log(found).sum(), 2 * np.log(diagonal).sum(), rtol=1e-14)
    assert (found > 0).all() and found[0] > found[-1]


def check(rows, found, components=32):
    kept = [(i, v) for i, v, _ in rows if v is not None and None not in v and np.isfinite(v).all()]
    x = np.floor(64 * np.array([v for _, v in kept], np.float32).astype(float)).astype(np.int64) + 1_000_000
    n, total = len(x), x.sum(axis=0)
    centred = (n * x - total) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(found) == n * components
    at = {}
    for r in found:
        at.setdefault(r["vec_id"], {})[r["component"]] = r
    for i, (vec_id, _) in enumerate(kept):
        mine = at[vec_id]
        assert sorted(mine) == list(range(1, components + 1))
        assert {r["n"] for r in mine.values()} == {n}
        assert {r["deviation"] for r in mine.values()} == {sum(int(v) ** 2 for v in n * x[i] - total)}
    for c in range(components):
        mine = np.array([at[i][c + 1]["whitened"] for i, _ in kept])
        want = centred @ vectors[:, c] / np.sqrt(values[c])
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-7
        assert np.isclose(found[0]["explained"], values[0] / values.sum(), rtol=1e-9) or found[0]["component"] != 1
    errors = {r["identity_error"] for r in found}
    assert len(errors) == 1 and errors.pop() < 1e-8


def test_query_against_numpy(spark, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    bad = [(10**6, None, 1), (10**6 + 1, [None] * 64, 1), (10**6 + 2, [float("nan")] * 64, 1), (10**6 + 3, [1.0] * 63 + [float("inf")], None)]
    table(spark, rows + bad).repartition(40).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = QUERIES["op11_embedding_whitening"](spark, str(tmp_path))
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert [t for _, t in found.dtypes] == ["bigint", "int", "bigint", "bigint", "double", "double", "double"]
    check(rows, found.collect())


def test_few_components_where_there_is_little_variance(spark):
    """Repeated rows, null ids, three directions of variance in five entries, a vector of another length, extra columns."""
    dice = np.random.default_rng(2)
    base = dice.integers(-50, 50, size=(40, 3)) / 64
    rows = [(i if i % 7 else None, [*map(float, b), 0.0, 1.0], i) for i, b in enumerate(base)] * 2 + [(99, [1.0, 2.0], 0), (98, [], 0)]
    df = table(spark, rows).withColumn("whitened", F.lit("x")).withColumn("N", F.lit(1))
    found = w.by_component(w.whiten(df)).collect()
    assert len(found) == 80 * 3 and {r["component"] for r in found} == {1, 2, 3} and {r["n"] for r in found} == {80}
    assert max(r["identity_error"] for r in found) < 1e-9
    assert np.isclose(sum({r["explained"] for r in found}), 1)


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0], 0)], [(1, [1.0, 2.0], 0)] * 5, [(1, None, 0)], [(1, [], 0)]])
def test_nothing_to_whiten(spark, rows):
    assert w.by_component(w.whiten(table(spark, rows))).collect() == []


def test_deviations_beyond_64_bits_are_exact():
    x = np.array([[10**15, -(10**15)], [7, 9]], np.int64)
    fit = w.Fit(10**6, [3 * 10**9 + 1, -5], np.ones(1), np.ones((2, 1)), 1.0)
    assert fit.deviations(x) == [sum((10**6 * int(v) - s) ** 2 for v, s in zip(r, fit.sums)) for r in x]
    small = w.Fit(3, [7, 9], np.ones(1), np.ones((2, 1)), 1.0)
    assert small.deviations(np.array([[2, 3]])) == [(6 - 7) ** 2 + 0]


def test_far_from_zero(spark):
    """Variance far below the mean: what the offset of a million would hide if squares were added before centring."""
    rows = [(i, [float(i % 2) / 64 + 4096.0, float(i % 3) / 64, float(i % 5) / 64], 0) for i in range(30)]
    found = w.by_component(w.whiten(table(spark, rows))).collect()
    check(rows, found, components=3)
