"""Embedding whitening: blockwise QR, Householder bidiagonalisation, dqds, twisted factorisations."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starboard.llm.common import ship_code, stored

COMPONENTS = 32
# Triangles that are reduced to one at a time.
FAN_IN = 16
EPS = np.finfo(float).eps
# A value this far below the next larger one, relatively, is in the same cluster: its direction is made orthogonal.
CLUSTER = 1e-3


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal and upper diagonal of B, and V, with r = U B V'. Householder reflections from both sides in turn."""
    a = np.array(r, float)
    d = a.shape[1]
    v = np.eye(d)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        size = np.linalg.norm(x)
        if not size:
            return None
        w = x / size
        w[0] += 1.0 if w[0] >= 0 else -1.0
        return w / np.linalg.norm(w)

    for k in range(d):
        if (w := reflector(a[k:, k])) is not None:
            a[k:, k:] -= 2 * np.outer(w, w @ a[k:, k:])
        if k + 2 < d and (w := reflector(a[k, k + 1 :])) is not None:
            a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ w, w)
            v[:, k + 1 :] -= 2 * np.outer(v[:, k + 1 :] @ w, w)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _transform(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float] | None:
    """One differential qd step with a shift: q, e, and a guess of the next shift, below the least value without one.

    None if the shift is beyond the least value.
    """
    new_q, new_e, d = [], [], q[0] - shift
    inverse = 0.0
    for i in range(len(e)):
        if d <= 0 and shift:
            return None
        inverse += 1 / d if d > 0 else np.inf
        new_q.append(d + e[i])
        ratio = q[i + 1] / new_q[i] if new_q[i] else 0.0
        new_e.append(e[i] * ratio)
        d = d * ratio - shift
    if d < 0 or not np.isfinite(d):
        return None
    inverse += 1 / d if d > 0 else np.inf
    return [*new_q, d], new_e, 1 / inverse


def dqds(diagonal: Sequence[float], upper: Sequence[float]) -> np.ndarray:
    """Squares of the singular values of an upper bidiagonal matrix, largest first, each to high relative accuracy.

    Differential quotient-difference steps, with shifts below the least value that is left, as no subtraction but that
    of the shift takes place. A value is taken off at the lower end when what ties it to the others is negligible.
    """
    q, e = [float(x) ** 2 for x in diagonal], [float(x) ** 2 for x in upper]
    found: list[float] = []
    largest = max([*q, *e], default=0.0)
    if not largest:
        return np.zeros(len(q))
    # Far below what rounding leaves of a singular value of zero.
    q = [max(x, largest * 1e-36) for x in q]
    blocks, start = [], 0
    for i, x in enumerate([*e, 0.0]):
        if x <= largest * 1e-40:
            blocks.append((q[start : i + 1], e[start:i], 0.0))
            start = i + 1
    while blocks:
        q, e, total = blocks.pop()
        bound, rounds = 0.0, 0
        while q:
            n = len(q)
            if q[-1] > 2 * q[0]:
                # The same singular values the other way round: small ones are to be at the lower end.
                q, e = q[::-1], e[::-1]
            if n == 1:
                found.append(total + q[0])
                break
            if e[-1] <= EPS**2 * (total + q[-1]):
                found.append(total + q[-1])
                q, e = q[:-1], e[:-1]
                continue
            if split := [i for i in range(n - 1) if e[i] <= EPS**2 * (total + min(q[i], q[i + 1]))]:
                i = split[-1]
                blocks.append((q[: i + 1], e[:i], total))
                q, e = q[i + 1 :], e[i + 1 :]
                continue
            # The least value of the last two by two, a little less; else a bound that is surely below all.
            half = (q[-2] + e[-1] + q[-1]) / 2
            product = q[-2] * q[-1]
            corner = product / (half + max(half * half - product, 0.0) ** 0.5)
            done = None
            for shift in (max(corner - e[-2] if n > 2 else corner * (1 - 4 * EPS), bound), bound * (1 - 4 * EPS), 0.0):
                if shift >= 0 and (done := _transform(q, e, shift)) is not None:
                    break
            if done is None or (rounds := rounds + 1) > 100 * n + 1000:
                raise ArithmeticError("the qd steps do not converge")
            q, e, bound = done
            total += shift
    return np.sort(np.array(found))[::-1]


def twisted_vector(diagonal: np.ndarray, upper: np.ndarray, value: float, start: np.ndarray | None = None) -> np.ndarray:
    """Unit eigenvector of B'B for an eigenvalue: from the twisted factorisation with the least pivot.

    The stationary and the progressive qd transform of B'B - value meet at each place; where they leave the least
    pivot, the vector is one there. With ``start`` the factorisation is solved for it instead.
    """
    n = len(diagonal)
    tiny = EPS * EPS * max(value, np.finfo(float).tiny)
    d, l = diagonal**2, upper / np.where(diagonal == 0, 1, diagonal)[:-1]  # noqa: E741
    low, plus, s = np.zeros(n - 1), np.zeros(n), -value
    stationary = np.zeros(n)
    for i in range(n - 1):
        stationary[i] = s
        plus[i] = s + d[i] or tiny
        low[i] = d[i] * l[i] / plus[i]
        s = low[i] * l[i] * s - value
    stationary[-1], plus[-1] = s, s + d[-1] or tiny
    up, minus, p = np.zeros(n - 1), np.zeros(n), d[-1] - value
    progressive = np.zeros(n)
    for i in range(n - 2, -1, -1):
        progressive[i + 1] = p
        minus[i + 1] = d[i] * l[i] ** 2 + p or tiny
        ratio = d[i] / minus[i + 1]
        up[i] = l[i] * ratio
        p = p * ratio - value
    progressive[0], minus[0] = p, p or tiny
    pivots = stationary + progressive + value
    k = int(np.argmin(np.abs(pivots)))
    z = np.zeros(n)
    if start is None:
        z[k] = 1.0
    else:
        # N D N' x = start, with N lower before k and upper after it.
        y = start.copy()
        for i in range(k):
            y[i + 1] -= low[i] * y[i]
        for i in range(n - 1, k, -1):
            y[i - 1] -= up[i - 1] * y[i]
        z[:k], z[k + 1 :] = y[:k] / plus[:k], y[k + 1 :] / minus[k + 1 :]
        z[k] = y[k] / (pivots[k] or tiny)
    for i in range(k - 1, -1, -1):
        z[i] -= low[i] * z[i + 1]
    for i in range(k, n - 1):
        z[i + 1] -= up[i] * z[i]
    return z / np.abs(z).max() / np.linalg.norm(z / np.abs(z).max())


def right_vectors(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest squared singular values of ``r`` that are not zero but for rounding, and their right vectors."""
    d = r.shape[1]
    scale = float(np.abs(r).max(initial=0.0))
    if not scale:
        return np.empty(0), np.empty((d, 0))
    diagonal, upper, outer = bidiagonal(r / scale)
    values = dqds(diagonal, upper)
    values = values[values > values[0] * (d * EPS) ** 2 * 16][:most]
    # Where B falls apart, the vectors of a part are zero outside it.
    largest = np.sqrt(values[0])
    edges = [0, *(np.flatnonzero(np.abs(upper) <= EPS * EPS * largest) + 1).tolist(), d]
    parts = []
    for first, end in zip(edges, edges[1:]):
        parts += [(v, first, end) for v in dqds(diagonal[first:end], upper[first : end - 1])]
    parts.sort(key=lambda p: -p[0])
    made = np.zeros((d, len(values)))
    for at, (value, first, end) in enumerate(parts[: len(values)]):
        some = slice(first, end)
        z = twisted_vector(diagonal[some], upper[first : end - 1], value)
        near = [
            j
            for j in range(at)
            if parts[j][1] == first and parts[j][0] - value <= CLUSTER * parts[j][0]
        ]
        if near:
            others = made[some, near]
            for _ in range(3):
                for _ in range(2):
                    rest = z - others @ (others.T @ z)
                    if np.linalg.norm(rest) < 1e-6:
                        # The same direction again: another start, the same for the same matrix.
                        rest = np.cos(np.arange(end - first) * (1.0 + at))
                        rest -= others @ (others.T @ rest)
                    z = rest / np.linalg.norm(rest)
                z = twisted_vector(diagonal[some], upper[first : end - 1], value, z)
            for _ in range(2):
                z -= others @ (others.T @ z)
                z /= np.linalg.norm(z)
        made[some, at] = z
    vectors = outer @ made
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])
    return values * scale * scale, vectors * signs


def whole_numbers(batch: pa.RecordBatch, column: int, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the rows that count, and their entries c as floor(64 c) + 1,000,000, in rows of ``d``."""
    lists = batch.column(column)
    offsets = lists.offsets.to_numpy()
    ok = (np.diff(offsets) == d) & ~lists.is_null().to_numpy(zero_copy_only=False)
    flat = lists.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(ok)
    entries = flat[offsets[rows][:, None] + np.arange(d)] if len(rows) else np.empty((0, d))
    finite = np.isfinite(entries).all(axis=1)
    steps = np.floor(64.0 * entries[finite])
    if len(steps) and np.abs(steps).max() >= 2.0**62:
        raise OverflowError("an entry is too large for a long")
    return rows[finite], steps.astype(np.int64) + 1_000_000


@dataclass
class Fit:
    """The fit list: ``n`` vectors with exact sums, the largest eigenvalues of their covariance and its trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        whole, rest = self.centre()
        return (x - whole) - rest / self.n

    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """S / n as whole parts and rests: x - S / n is then exact but for its last rounding, however large S is."""
        return np.array([s // self.n for s in self.sums], np.int64), np.array([s % self.n for s in self.sums], np.int64)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int]:
        """The sum over all entries of (n x - S)^2, exactly."""
        whole, rest = self.centre()
        moved = x - whole
        largest = int(np.abs(moved).max(initial=0)) * self.n + self.n
        if largest * largest * max(x.shape[1], 1) < 1 << 62:
            return np.square(moved * self.n - rest).sum(axis=1).tolist()
        exact = moved.astype(object) * self.n - rest.astype(object)
        return (exact * exact).sum(axis=1).tolist() if len(x) else []


def _dimension(vectors: DataFrame) -> int:
    """The most frequent length, the longer of equally frequent ones; 0 without vectors."""
    sizes = vectors.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).where("d > 0")
    first = sizes.orderBy(F.desc("n"), F.desc("d")).first()
    return first["d"] if first else 0


def _exact_sums(vectors: DataFrame, d: int) -> tuple[int, list[int]]:
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = [0] * d, 0
        for batch in batches:
            _, x = whole_numbers(batch, 0, d)
            for some in np.array_split(x, len(x) // 1024 + 1):
                # In halves, so that no sum of a thousand passes 64 bits.
                high, low = (some >> 32).sum(axis=0).tolist(), (some & 0xFFFFFFFF).sum(axis=0).tolist()
                total = [t + (h << 32) + o for t, h, o in zip(total, high, low)]
            n += len(x)
        out = [pa.array(range(-1, d), pa.int32()), pa.array([str(t) for t in (n, *total)])]
        yield pa.RecordBatch.from_arrays(out, ["at", "total"])

    found = vectors.mapInArrow(sums, "at int, total string")
    rows = found.groupBy("at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    total = {r["at"]: int(r["total"]) for r in rows}
    return total.get(-1, 0), [total.get(i, 0) for i in range(d)]


def _triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r") if len(rows) else rows


def centred_triangle(vectors: DataFrame, fit: Fit) -> np.ndarray:
    """R of the QR decomposition of all centred rows: one for each task, then sixteen at a time into one.

    The driver gets the last one, d x d.
    """
    d = len(fit.sums)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.empty((0, d))
        for batch in batches:
            _, x = whole_numbers(batch, 0, d)
            for some in np.array_split(x, len(x) // (4 * d + 256) + 1):
                if len(some):
                    r = _triangle(np.concatenate([r, fit.centred(some)]))
        if len(r):
            yield pa.RecordBatch.from_pydict(
                {"at": pa.array([TaskContext.get().partitionId()], pa.int64()), "r": pa.array([r.tobytes()], pa.binary())}
            )

    def merged(table: pa.Table) -> pa.Table:
        rows = table.sort_by("at")
        r = np.empty((0, d))
        for some in rows.column("r"):
            r = _triangle(np.concatenate([r, np.frombuffer(some.as_py()).reshape(-1, d)]))
        return pa.table({"at": pa.array([rows.column("at")[0].as_py() // FAN_IN], pa.int64()), "r": pa.array([r.tobytes()], pa.binary())})

    found = stored(vectors.mapInArrow(blocks, "at long, r binary"), "triangles")
    most = found.agg(F.max("at")).first()[0]
    while most is not None and most > 0:
        group = F.floor(F.col("at") / FAN_IN)
        found = stored(found.groupBy(group).applyInArrow(merged, "at long, r binary"), "triangles")
        most //= FAN_IN
    last = found.first()
    return np.frombuffer(last["r"]).reshape(-1, d) if last else np.empty((0, d))


def fit_whitening(vectors: DataFrame, components: int) -> Fit | None:
    """The whitening of all vectors of the column ``v``; None if there are none, or all are equal."""
    d = _dimension(vectors)
    n, sums = _exact_sums(vectors, d) if d else (0, [])
    if not n:
        return None
    fit = Fit(n, sums, np.empty(0), np.empty((d, 0)), 0.0)
    r = centred_triangle(vectors, fit)
    square = np.zeros((d, d))
    square[: len(r)] = r
    values, fit.vectors = right_vectors(square, components)
    fit.values, fit.trace = values / n, float(np.square(r).sum() / n)
    return fit if len(values) else None


def identity_error(vectors: DataFrame, fit: Fit) -> float:
    """The largest entry by which the covariance of the whitened rows differs from the identity.

    Each task centres its own rows; counts, means and products add up exactly as those of one list do.
    """
    k, d = len(fit.values), len(fit.sums)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, products = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            _, x = whole_numbers(batch, 0, d)
            if len(x):
                w = fit.whitened(x)
                here = w.mean(axis=0)
                apart = here - mean
                centred = w - here
                products += centred.T @ centred + np.outer(apart, apart) * (n * len(w) / (n + len(w)))
                n += len(w)
                mean += apart * (len(w) / n)
        if n:
            yield pa.RecordBatch.from_pydict(
                {
                    "i": pa.array(np.repeat(np.arange(k, dtype=np.int32), k)),
                    "j": pa.array(np.tile(np.arange(k, dtype=np.int32), k)),
                    "n": pa.array([n] * k * k, pa.int64()),
                    "mi": pa.array(np.repeat(mean, k)),
                    "mj": pa.array(np.tile(mean, k)),
                    "p": pa.array(products.reshape(-1)),
                }
            )

    parts = vectors.mapInArrow(moments, "i int, j int, n long, mi double, mj double, p double")
    n = F.col("n")
    whole = parts.groupBy("i", "j").agg(
        F.sum("p").alias("p"), F.sum(n * F.col("mi") * F.col("mj")).alias("m"), F.sum(n * F.col("mi")).alias("si"), F.sum(n * F.col("mj")).alias("sj")
    )
    covariance = (F.col("p") + F.col("m") - F.col("si") * F.col("sj") / fit.n) / fit.n
    return whole.agg(F.max(F.abs(covariance - (F.col("i") == F.col("j")).cast("double")))).first()[0]


def whiten(
    rows: DataFrame, *, carry: Sequence[str] = ("vec_id",), vector: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """A row for each vector: ``carry``, ``whitened`` (array), ``n``, ``deviation`` (decimal), ``explained`` (array),
    ``identity_error``.

    Vectors that are null, or hold null or non-finite entries, are left out, as are those of another length than most
    (and empty ones), which are no points of the same space. An entry c counts as floor(64 c) + 1,000,000; one that no
    long can hold is an error. Components are the eigenvectors of the covariance of all vectors that remain, numbered by
    falling eigenvalue; there are ``components`` of them, or as many as have variance. Repeated rows count each time.
    No vectors, or vectors that are all equal, give no rows. Other columns are not read.

    Passes over the input: lengths, exact sums, triangles, error, result. The driver gets sums and one triangle of d x d
    numbers, d being the length of a vector.
    """
    ship_code(rows.sparkSession)
    read = rows.select(*carry, F.col(vector).cast("array<double>").alias("v"))
    usable = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    read = read.where(usable)
    vectors = read.select("v")
    fit = fit_whitening(vectors, components)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema.fields[:-1])
    schema = f"{fields}, whitened array<double>, deviation decimal(38,0)"
    if fit is None:
        found = read.where("false").select(*carry, F.col("v").alias("whitened"), F.lit(0).cast("decimal(38,0)").alias("deviation"))
        n, explained, error = 0, [], 0.0
    else:
        d, k = len(fit.sums), len(carry)

        def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, x = whole_numbers(batch, k, d)
                white = fit.whitened(x)
                columns = [batch.column(i).take(pa.array(at)) for i in range(k)]
                ends = pa.array(np.arange(0, white.size + 1, white.shape[1], dtype=np.int32))
                columns.append(pa.ListArray.from_arrays(ends, pa.array(white.reshape(-1))))
                columns.append(pa.array(list(map(_decimal, fit.deviations(x))), pa.decimal128(38, 0)))
                yield pa.RecordBatch.from_arrays(columns, [*carry, "whitened", "deviation"])

        found = read.mapInArrow(applied, schema)
        n, explained, error = fit.n, (fit.values / fit.trace).tolist(), identity_error(vectors, fit)
    parts = F.array(*map(F.lit, explained)) if explained else F.array().cast("array<double>")
    return found.select(
        *carry, "whitened", F.lit(n).cast("long").alias("n"), "deviation", parts.alias("explained"), F.lit(error).alias("identity_error")
    )


def _decimal(value: int):
    from decimal import Decimal

    return Decimal(value)


def by_component(white: DataFrame, carry: Sequence[str] = ("vec_id",)) -> DataFrame:
    """A row for each vector and component, from 1. A deviation beyond 64 bits is null."""
    each: Column = F.explode(F.arrays_zip(F.sequence(F.lit(1), F.size("whitened")).alias("component"), "whitened", "explained"))
    found = white.select(*carry, "n", "deviation", "identity_error", each.alias("c"))
    deviation = F.expr("try_cast(deviation AS BIGINT)").alias("deviation")
    return found.select(*carry, F.col("c.component"), "n", deviation, "c.whitened", "c.explained", "identity_error")
