"""Near vectors against brute force in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from starboard.llm import embedding_dedup as e
from starboard.llm.queries import QUERIES

FIELDS = "vec_id long, embedding array<float>, label int"


def brute(rows, cosine=0.93):
    """(vec_id, n_links, component_id, kept) for each row; ids are not null here."""
    ok = [v is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and any(v) and lab is not None for _, v, lab in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    groups = {}
    for i, (_, v, lab) in enumerate(rows):
        if ok[i]:
            groups.setdefault((lab, len(v)), []).append(i)
    for members in groups.values():
        x = np.array([rows[i][1] for i in members], np.float32).astype(float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        near = x @ x.T >= cosine
        for a, i in enumerate(members):
            links[i] = int(near[a].sum()) - int(near[a, a])
            for b in np.flatnonzero(near[a]):
                parent[find(i)] = find(members[b])
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted((r[0], links[i], least[find(i)], r[0] == least[find(i)]) for i, r in enumerate(rows))


def vectors(seed, n=3000, d=64, labels=3):
    """Random vectors, with copies, near copies from a hair's breadth to just beyond the threshold, and a large group."""
    dice = np.random.default_rng(seed)
    base = dice.normal(size=(n, d))
    rows = []
    for i, v in enumerate(base):
        rows.append((v, int(dice.integers(labels))))
        if i % 10 == 0:
            for _ in range(int(dice.integers(1, 5))):
                side = dice.normal(size=d)
                side *= np.linalg.norm(v) / np.linalg.norm(side) * dice.uniform(0, 0.42)
                rows.append((v + side, rows[-1][1] if dice.random() < 0.9 else 0))
        if i % 25 == 0:
            rows += [rows[-1]] * 2
    rows += [(base[0] + 0.1 * dice.normal(size=d), 1) for _ in range(700)] + [(base[1], 2)] * 500
    order = dice.permutation(len(rows))
    return [(int(k) * 3, [float(x) for x in rows[i][0].astype(np.float32)], rows[i][1]) for k, i in enumerate(order)]


def odd(start):
    inf, nan = float("inf"), float("nan")
    values = [None, [], [0.0] * 64, [None] * 64, [nan] * 64, [1.0, inf], [1.0, 0.0], [2.0, 0.0], [1.0, 0.0, 0.0], [1e30, 1e30], [1e-30, 1e-30], [-0.0, 1.0], [0.0, 1.0]]
    return [(start + i, v, 1) for i, v in enumerate(values)] + [(start + 50, [1.0, 0.0], None), (start + 51, [1.0] * 64, None)]


def table(spark, rows, folder, files=7):
    spark.createDataFrame(rows, FIELDS).repartition(files).write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def result(df):
    return sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_all_links_within_the_radius(spark, seed):
    """With a target of all neighbours the bound is the radius, which loses none; slices and cells are small here."""
    rows = vectors(seed, n=1200) + odd(10**6)
    df = spark.createDataFrame(rows, FIELDS)
    found = e.near_vectors(df, recall=1.0, cell_rows=16, slice_rows=100)
    want = brute(rows)
    assert len(result(found)) == len(want)
    missed = sum(b[1] - a[1] for a, b in zip(result(found), want))
    assert 0 <= missed <= 0.002 * sum(w[1] for w in want)


def test_exact_when_the_reach_is_the_radius(spark, monkeypatch):
    rows = vectors(3, n=800) + odd(10**6)
    fit = e.fit_index

    def whole(*args):
        index = fit(*args)
        index.reach = 2 - 2 * 0.93
        return index

    monkeypatch.setattr(e, "fit_index", whole)
    found = e.near_vectors(spark.createDataFrame(rows, FIELDS), cell_rows=16, slice_rows=64)
    assert result(found) == brute(rows)


def test_query_reaches_its_recall(spark, tmp_path):
    rows = vectors(4)
    found = QUERIES["op12_embedding_near_dedup"](spark, table(spark, rows, tmp_path))
    assert found.columns[:4] == ["vec_id", "n_links", "component_id", "kept"]
    assert [t for _, t in found.dtypes[:4]] == ["bigint", "bigint", "bigint", "boolean"]
    got, want = result(found), brute(rows)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert all(g[1] <= w[1] for g, w in zip(got, want))
    assert sum(g[1] for g in got) >= 0.98 * sum(w[1] for w in want)
    assert sum(g[2] == w[2] for g, w in zip(got, want)) >= 0.98 * len(want)
    measured = e.near_vectors(spark.read.parquet(f"{tmp_path}/embeddings.parquet")).select("recall").distinct()
    assert [r["recall"] >= 0.98 for r in measured.collect()] == [True]


def test_given_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert result(QUERIES["op12_embedding_near_dedup"](spark, sf)) == brute(rows)


def test_sql_finds_the_same_links(spark, tmp_path):
    """The registered SQL on vectors that do have links."""
    import duckdb

    from starboard.llm.queries import SQL

    rows = vectors(6, n=150, d=8)[:400] + [(10**6, None, 1), (10**6 + 1, [0.0] * 8, 1), (10**6 + 2, [1.0] * 8, None)]
    spark.createDataFrame(rows, FIELDS).coalesce(1).write.parquet(f"{tmp_path}/e")
    (file,) = tmp_path.glob("e/part-*.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{file}'")
    found = con.execute(SQL["op12_embedding_near_dedup"]).fetchall()
    assert sorted(found) == brute(rows) and sum(r[1] for r in found) > 100


def test_no_rows_repeated_ids_and_clashing_columns(spark):
    empty = spark.createDataFrame([], FIELDS)
    assert e.near_vectors(empty).collect() == []
    rows = [(None, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (5, [1.0, 0.01], 1), (5, [0.0, 1.0], 1), (9, None, 1), (None, None, None)]
    df = spark.createDataFrame(rows, FIELDS).withColumn("node", F.lit("x")).withColumn("N", F.lit(1)).withColumn("h1", F.lit(0))
    found = e.near_vectors(df)
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in found.collect()), key=str)
    want = [(None, 2, 5, False), (None, 2, 5, False), (5, 2, 5, True), (5, 0, 5, True), (9, 0, 9, True), (None, 0, None, True)]
    assert got == sorted(want, key=str)


def test_cells_come_in_order_of_distance():
    dice = np.random.default_rng(0)
    for _ in range(50):
        u, v = dice.random(dice.integers(1, 9)).round(1), dice.random(dice.integers(1, 9)).round(1)
        found = list(e.in_order(u, v, 0.9))
        sums = [u[i] + v[j] for i, j in found]
        assert sums == sorted(sums)
        assert set(found) == {(i, j) for i in range(len(u)) for j in range(len(v)) if u[i] + v[j] <= 0.9}


def test_bounds_are_never_above_the_distance():
    dice = np.random.default_rng(1)
    units = e.unit_rows(dice.normal(size=(400, 10)))
    index = e.Index(e.codebook(units[:, :5], 9), e.codebook(units[:, 5:], 7), 0.0)
    a, b = units[dice.integers(400, size=2000)], units[dice.integers(400, size=2000)]
    assert (index.needed(a, b) <= np.square(a - b).sum(axis=1) + 1e-12).all()
