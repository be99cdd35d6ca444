"""Near-duplicate vectors: an inverted multi-index over vector halves, verified by exact cosines."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starboard.llm.common import ship_code, stored
from starboard.llm.components import connected_components

COSINE = 0.93
RECALL = 0.99
# Vectors that the codebooks are learned from, and of these the queries that are held against all vectors.
SAMPLE = 20_000
QUERIES = 256
# Vectors a cell is to have on average in the largest label, and centres of a codebook at most.
CELL_ROWS = 256
CENTRES = 512
# Vectors on one side of a comparison.
SLICE = 2048
# Steps of the bound up to the radius.
STEPS = 256


def unit_rows(values: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; the largest entry is scaled first, so that no square overflows."""
    values = values.astype(float)
    values = values / np.abs(values).max(axis=1, keepdims=True)
    return values / np.linalg.norm(values, axis=1, keepdims=True)


def codebook(points: np.ndarray, centres: int, rounds: int = 10) -> np.ndarray:
    """Centres by Lloyd's iterations, from the first different points; fewer if there are fewer."""
    _, first = np.unique(points, axis=0, return_index=True)
    found = points[np.sort(first)[:centres]]
    for _ in range(rounds):
        nearest = squares(points, found).argmin(axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, nearest, points)
        n = np.bincount(nearest, minlength=len(found))
        found = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], found)
    return np.unique(found, axis=0)


def squares(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, but for a number for each point."""
    return (centres * centres).sum(axis=1) - 2 * points @ centres.T


def in_order(u: np.ndarray, v: np.ndarray, limit: float) -> Iterator[tuple[int, int]]:
    """Multi-sequence traversal: (i, j) by rising u[i] + v[j], as far as ``limit``.

    A cell comes up for a place in the queue when both cells before it in the two sequences have been visited.
    """
    by_u, by_v = np.argsort(u, kind="stable"), np.argsort(v, kind="stable")
    us, vs = u[by_u].tolist(), v[by_v].tolist()
    waiting, visited = [(us[0] + vs[0], 0, 0)], set()
    while waiting:
        bound, i, j = heapq.heappop(waiting)
        if bound > limit:
            return
        visited.add((i, j))
        yield int(by_u[i]), int(by_v[j])
        if i + 1 < len(us) and (j == 0 or (i + 1, j - 1) in visited):
            heapq.heappush(waiting, (us[i + 1] + vs[j], i + 1, j))
        if j + 1 < len(vs) and (i == 0 or (i - 1, j + 1) in visited):
            heapq.heappush(waiting, (us[i] + vs[j + 1], i, j + 1))


@dataclass
class Index:
    """Codebooks for the two halves of unit vectors. A cell is a pair of centres, numbered row by row.

    Two vectors in different cells are at least as far apart as one of them is from the other's cell; of a half, that
    is its distance from the plane between the nearest centre and the other. ``reach`` is the squared distance up to
    which cells are visited.
    """

    first: np.ndarray
    second: np.ndarray
    reach: float
    recall: float | None = None

    def bounds(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The cell of each vector, and squared distances to the cells of each half."""
        half = self.first.shape[1]
        u, at_u = self._planes(units[:, :half], self.first)
        v, at_v = self._planes(units[:, half:], self.second)
        return at_u * len(self.second) + at_v, u, v

    @staticmethod
    def _planes(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        away = squares(points, centres)
        nearest = away.argmin(axis=1)
        between = np.sqrt(np.maximum(((centres[:, None] - centres[None]) ** 2).sum(axis=2), 1e-300))
        apart = (away - away[np.arange(len(points)), nearest][:, None]) / (2 * between[nearest])
        apart[np.arange(len(points)), nearest] = 0.0
        return np.square(np.maximum(apart, 0.0)), nearest

    def visits(self, units: np.ndarray) -> Iterator[tuple[int, int, list[int]]]:
        """For each vector its number, its cell, and the cells after its own that are within reach, nearest first.

        Cells before its own are left out: their vectors visit this one.
        """
        cells, u, v = self.bounds(units)
        for at, cell in enumerate(cells.tolist()):
            others = (i * len(self.second) + j for i, j in in_order(u[at], v[at], self.reach))
            yield at, cell, [c for c in others if c > cell]

    def needed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The reach at which each vector of ``a`` meets the one of ``b``."""
        (cell_a, ua, va), (cell_b, ub, vb) = self.bounds(a), self.bounds(b)
        n, at = len(self.second), np.arange(len(a))
        from_a = ua[at, cell_b // n] + va[at, cell_b % n]
        from_b = ub[at, cell_a // n] + vb[at, cell_a % n]
        return np.where(cell_a <= cell_b, from_a, from_b)


def _units(batch: pa.RecordBatch, column: str, d: int, kind: str) -> np.ndarray:
    """Binary vectors of one or several lengths as unit rows of ``d``, the shorter ones with zeros behind."""
    values = batch.column(column).to_pylist()
    out = np.zeros((len(values), d))
    for i, value in enumerate(values):
        some = np.frombuffer(value, kind)
        out[i, : len(some)] = some
    return unit_rows(out) if len(out) else out


def fit_index(nodes: DataFrame, d: int, kind: str, cosine: float, recall: float, cell_rows: int) -> Index:
    """Codebooks from a sample of ``SAMPLE`` vectors, and the reach for the target recall.

    The reach is learned from two sides. Sampled vectors get neighbours at just the least cosine in random directions,
    and must meet ``recall`` of them. ``QUERIES`` vectors are held against all others of their label by brute force, and
    must meet ``recall`` of the neighbours they really have; what they meet is the recall that is reported. The driver
    gets the sample, and counts by steps of the reach.
    """
    spaces = nodes.groupBy("label", "d").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    wanted = int(np.clip(round(np.sqrt(spaces / cell_rows)), 2, CENTRES))
    sample = nodes.orderBy("h1", "h2").limit(SAMPLE).select("node", "label", "d", "v").toArrow()
    batches = sample.combine_chunks().to_batches()
    units = _units(batches[0], "v", d, kind) if batches else np.zeros((0, d))
    half = d // 2
    if not len(units):
        return Index(np.zeros((1, half)), np.zeros((1, d - half)), 0.0)
    index = Index(codebook(units[:, :half], wanted), codebook(units[:, half:], wanted), 0.0)
    radius = 2 - 2 * cosine

    dice = np.random.default_rng(0)
    some = units[:2000]
    aside = dice.normal(size=some.shape)
    aside -= (aside * some).sum(axis=1, keepdims=True) * some
    sizes = np.linalg.norm(aside, axis=1, keepdims=True)
    planted = cosine * some + np.sqrt(1 - cosine * cosine) * aside / np.where(sizes > 0, sizes, 1)
    index.reach = float(np.quantile(index.needed(some, planted), recall))

    asked = units[:QUERIES]
    names = list(zip(sample["label"].to_pylist()[:QUERIES], sample["d"].to_pylist()[:QUERIES]))
    own = np.array(sample["node"].to_pylist()[:QUERIES])
    code = {name: i for i, name in enumerate(dict.fromkeys(names))}
    of_query = np.array([code[name] for name in names])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(STEPS + 1, np.int64)
        for batch in batches:
            rows = _units(batch, "v", d, kind)
            of_row = [code.get(name, -1) for name in zip(batch.column("label").to_pylist(), batch.column("d").to_pylist())]
            nodes = batch.column("node").to_numpy()
            near = (rows @ asked.T >= cosine) & (np.array(of_row)[:, None] == of_query) & (nodes[:, None] != own)
            at, query = np.nonzero(near)
            for first in range(0, len(at), 4096):
                steps = index.needed(rows[at[first : first + 4096]], asked[query[first : first + 4096]]) * (STEPS / radius)
                counts += np.bincount(np.clip(np.ceil(steps), 0, STEPS).astype(int), minlength=STEPS + 1)
        yield pa.RecordBatch.from_pydict({"step": pa.array(range(STEPS + 1), pa.int32()), "n": pa.array(counts)})

    found = nodes.select("node", "label", "d", "v").mapInArrow(met, "step int, n long")
    counts = np.zeros(STEPS + 1, np.int64)
    for r in found.groupBy("step").agg(F.sum("n").alias("n")).collect():
        counts[r["step"]] = r["n"]
    if counts.sum():
        so_far = np.cumsum(counts) / counts.sum()
        index.reach = max(index.reach, int(np.argmax(so_far >= recall)) * radius / STEPS)
        index.recall = float(so_far[min(int(index.reach * STEPS / radius), STEPS)])
    return index


def _local_roots(a: np.ndarray, b: np.ndarray, root: np.ndarray) -> np.ndarray:
    """``root`` (the least number of each one's component) after links between a and b."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (root[root] != root).any():
            root = root[root]


LEFT, RIGHT = 1, 2


def compared(table: pa.Table, cosine: float, d: int, kind: str) -> pa.Table:
    """All vectors on the left against all on the right: for each with a link, how many rows it links to, and one link.

    Two members of the cell are compared once, the one with the lower number on the left. The links are those of a
    spanning forest, whatever the number of pairs.
    """
    batch = table.combine_chunks().to_batches()[0]
    role, node, weight = (batch.column(c).to_numpy() for c in ("role", "node", "w"))
    member = batch.column("member").to_numpy(zero_copy_only=False)
    units = _units(batch, "v", d, kind)
    right = np.flatnonzero(role & RIGHT)
    left = np.flatnonzero(role & LEFT)
    names, local = np.unique(node, return_inverse=True)
    links, root = np.zeros(len(names), np.int64), np.arange(len(names))
    for first in range(0, len(left) if len(right) else 0, 512):
        some = left[first : first + 512]
        near = units[some] @ units[right].T >= cosine
        near &= ~member[some][:, None] | (node[some][:, None] < node[right][None])
        i, j = np.nonzero(near)
        a, b = local[some[i]], local[right[j]]
        np.add.at(links, a, weight[right[j]])
        np.add.at(links, b, weight[some[i]])
        root = _local_roots(a, b, root)
    has = links > 0
    return pa.table({"node": names[has], "n": links[has], "root": names[root[has]]})


def _linked(nodes: DataFrame, index: Index, d: int, kind: str, cosine: float, slice_rows: int) -> DataFrame:
    """``node``, ``n``, ``root``: partial numbers of linked rows, and links of spanning forests."""
    shape = T.StructType([f for f in nodes.schema if f.name in ("label", "d")])
    cell_schema = T.StructType([*shape, T.StructField("cell", T.IntegerType()), T.StructField("n", T.LongType())])
    dealt_schema = T.StructType(
        [
            *shape,
            T.StructField("cell", T.IntegerType()),
            T.StructField("member", T.BooleanType()),
            *(f for f in nodes.schema if f.name in ("node", "w", "v")),
        ]
    )

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[tuple, int] = {}
            spaces = list(zip(batch.column("label").to_pylist(), batch.column("d").to_pylist()))
            for at, cell, others in index.visits(_units(batch, "v", d, kind)):
                for c in (cell, *others):
                    key = (*spaces[at], c)
                    counts[key] = counts.get(key, 0) + 1
            names = list(zip(*counts)) or [(), (), ()]
            columns = [pa.array(names[0], batch.column("label").type), pa.array(names[1], pa.int32()), pa.array(names[2], pa.int32())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts.values(), pa.int64())], ["label", "d", "cell", "n"])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, cells, member = [], [], []
            for i, cell, others in index.visits(_units(batch, "v", d, kind)):
                at += [i] * (1 + len(others))
                cells += [cell, *others]
                member += [True] + [False] * len(others)
            taken = pa.array(at, pa.int64())
            columns = {"label": batch.column("label").take(taken), "d": batch.column("d").take(taken)}
            columns |= {"cell": pa.array(cells, pa.int32()), "member": pa.array(member, pa.bool_())}
            columns |= {c: batch.column(c).take(taken) for c in dealt_schema.names[4:]}
            yield pa.RecordBatch.from_pydict(columns)

    narrow = nodes.select("label", "d", "v")
    counts = narrow.mapInArrow(sizes, cell_schema).groupBy("label", "d", "cell").agg(F.sum("n").alias("n"))
    counts = counts.where(F.col("n") > slice_rows)
    cuts = F.ceil(F.col("n") / slice_rows).cast("int").alias("cuts")
    # Cells that are too large for one task; as a written table it is joined without moving the others if it is small.
    large = stored(counts.select("label", "d", "cell", cuts), "large-cells")
    rows = nodes.select(*dealt_schema.names[:2], *dealt_schema.names[4:]).mapInArrow(dealt, dealt_schema)
    rows = rows.join(large, ["label", "d", "cell"], "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    mine = F.pmod(F.xxhash64("node"), "cuts").cast("int")
    # Slices of the left side by those of the right side; a member is on both, in one row where they meet.
    on_left = F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda y: F.struct(mine.alias("x"), y.alias("y"), F.when((y == mine) & F.col("member"), LEFT | RIGHT).otherwise(LEFT).alias("role")))
    on_right = F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda x: F.struct(x.alias("x"), mine.alias("y"), F.lit(RIGHT).alias("role")))
    on_right = F.filter(on_right, lambda s: s["x"] != mine)
    places = F.when(F.col("member"), F.concat(on_left, on_right)).otherwise(on_left)
    placed = rows.withColumn("at", F.explode(places)).select(*dealt_schema.names, "at.x", "at.y", "at.role")
    groups = placed.groupBy("label", "d", "cell", "x", "y")
    return groups.applyInArrow(lambda t: compared(t, cosine, d, kind), "node long, n long, root long")


def near_vectors(
    rows: DataFrame,
    *,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    cosine: float = COSINE,
    recall: float = RECALL,
    cell_rows: int = CELL_ROWS,
    slice_rows: int = SLICE,
) -> DataFrame:
    """A row for each row: ``vec_id``, ``n_links``, ``component_id``, ``kept``, ``recall``.

    Two rows link if their labels are equal and not null and the cosine of their vectors, in double precision, is at
    least ``cosine``. ``n_links`` counts the rows linked directly, ``component_id`` is the least id that links lead to,
    nulls last, and ``kept`` says that it is the row's own.

    Equal vectors of a label are one node with a weight, so copies meet nothing twice. Every node is in the index; it
    visits cells by rising distance as far as the target ``recall`` asks (see ``fit_index``), so that a few
    links may be missed, while none is made up: every pair that meets is verified. ``recall`` is what was measured on the
    query set against brute force, null if its vectors have no neighbours. Cells with many vectors are cut
    into slices that are compared two by two in tasks of their own; what comes out of a task is one row for each vector.

    Vectors that are null, empty or all zero, or hold null or non-finite entries, and rows without a label, link with
    nothing. Vectors of different lengths do not link. Rows with the same id, or none, are rows of their own. An empty
    table gives no rows. Other columns are not read.
    """
    ship_code(rows.sparkSession)
    element = rows.schema[vector].dataType.elementType
    kind = "<f4" if isinstance(element, T.FloatType) else "<f8"
    values = F.col(vector) if kind == "<f4" else F.col(vector).cast("array<double>")
    read = rows.select(F.col(vec_id).alias("id"), F.col(label).alias("label"), values.alias("v"))
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    links = F.coalesce(F.col("label").isNotNull() & usable, F.lit(False))
    key = [F.xxhash64(F.lit(seed), "label", "v").alias(name) for seed, name in ((1, "h1"), (2, "h2"))]
    linkable = read.where(links).select("id", "label", "v", *key)
    alone = read.where(~links).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype(kind)
            data = [flat[a:b].tobytes() for a, b in zip(offsets, offsets[1:])]
            columns = {c: batch.column(c) for c in batch.schema.names if c != "v"}
            columns |= {"d": pa.array(np.diff(offsets), pa.int32()), "v": pa.array(data, pa.binary())}
            yield pa.RecordBatch.from_pydict(columns)

    distinct = linkable.groupBy("h1", "h2", "label", "v").agg(F.count(F.lit(1)).alias("w"), F.min("id").alias("least"))
    distinct = distinct.withColumn("node", F.monotonically_increasing_id()).select("h1", "h2", "label", "w", "least", "node", "v")
    fields = [f for f in distinct.schema if f.name != "v"]
    schema = T.StructType([*fields, T.StructField("d", T.IntegerType()), T.StructField("v", T.BinaryType())])
    nodes = stored(distinct.mapInArrow(packed, schema), "vectors")
    d = max(nodes.agg(F.max("d")).first()[0] or 0, 2)
    index = fit_index(nodes, d, kind, cosine, recall, cell_rows)

    found = stored(_linked(nodes, index, d, kind, cosine, slice_rows), "vector-links")
    counted = found.groupBy("node").agg(F.sum("n").alias("n"))
    roots = connected_components(found.where("node <> root"), "node", "root")
    known = nodes.select("node", "h1", "h2", "w", "least").join(counted, "node", "left").join(roots, "node", "left")
    known = stored(known.withColumn("root", F.coalesce("root", "node")), "vector-roots")
    firsts = known.where("n IS NOT NULL").groupBy("root").agg(F.min("least").alias("first"))
    known = known.join(firsts, "root", "left").select(
        "h1",
        "h2",
        (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"),
        F.when(F.col("n").isNotNull(), F.col("first")).otherwise(F.col("least")).alias("component"),
    )
    # Equal vectors of one label have one 128-bit key, so that rows find their node without moving vectors again.
    linked = linkable.select("id", "h1", "h2").join(known, ["h1", "h2"]).select("id", "n_links", "component")
    return linked.unionByName(alone).select(
        F.col("id").alias("vec_id"),
        "n_links",
        F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"),
        F.lit(index.recall).cast("double").alias("recall"),
    )
