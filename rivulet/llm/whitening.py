"""Embedding whitening: principal components of quantised vectors, from a compensated covariance.

Three passes over the vectors. The first sums every dimension exactly (long halves, joined as Python integers). The second
centres each vector by the exact mean, held as a double-double, and adds its outer product to a double-double sum: products
and sums are split by error-free transformations, so what rounding drops is kept in the low parts. A task sums its rows in
a few lanes of one upper triangle and emits high and low parts; these are merged across tasks in two rounds of salted
groups, so no task meets the parts of all others. Only the merged triangle reaches the driver: its size is that of the
dimensions squared, whatever the rows.

There, Householder reflections make the covariance tridiagonal, divide and conquer solves it (halves joined by a rank-one
change, with deflation, the secular equation by bisection from the nearer pole, and vectors from the weights that make the
computed roots exact), and steps of Newton type in extended precision take the vectors to the last bits of the
double-double matrix. The last pass projects the rows; one more aggregates the covariance of what it gives.

Vectors of up to some thousand dimensions are meant: a task holds the triangle of one lane some ten times over.

Defined results: rows whose vector is null or holds null or non-finite entries are left out, and so are those with an
entry whose quantised value is beyond 2**52 in size, and those of another length than the commonest (of equally common
ones, the least). Empty vectors have no dimension and are left out too. Repeated rows and null ids are rows like any other.
Components are numbered by falling eigenvalue, equal ones in any order; each vector's largest entry is made positive. A
component without variance (eigenvalue not above rounding) has no scale: its ``whitened`` is null, and it is left out of
``identity_error``, which is null where no component has variance; ``explained`` is then null as well. A ``deviation``
beyond 64 bits is null. An empty table, or one of rows left out, gives no rows. Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pairs of dimensions (times lanes) that a task adds at once, about; pairs of a merged row; groups of the first merge.
_WIDE = 1 << 16
_BLOCK = 4096
_SALTS = 64
_HALF = 26
_SPLIT = float(2**27 + 1)

Pair = tuple[np.ndarray, np.ndarray]


# ---- double-double arithmetic


def two_sum(a: np.ndarray, b: np.ndarray) -> Pair:
    """a + b as a rounded sum and its error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def halves(a: np.ndarray) -> Pair:
    """a as two parts of at most 26 bits."""
    c = _SPLIT * a
    high = c - (c - a)
    return high, a - high


def dd_add(a: Pair, b: Pair) -> Pair:
    s, e = two_sum(a[0], b[0])
    e = e + (a[1] + b[1])
    high = s + e
    return high, e - (high - s)


class Outer:
    """The upper triangle of a sum of outer products of double-double vectors."""

    def __init__(self, dims: int):
        self.i, self.j = np.triu_indices(dims)
        self.lanes = max(1, _WIDE // len(self.i))
        self.sum: Pair = (np.zeros((self.lanes, len(self.i))), np.zeros((self.lanes, len(self.i))))

    def add(self, high: np.ndarray, low: np.ndarray) -> None:
        """Add the products of rows."""
        first, second = halves(high)
        for at in range(0, len(high), self.lanes):
            rows = slice(at, at + self.lanes)
            n = len(high[rows])
            h, l_, f, s = high[rows], low[rows], first[rows], second[rows]
            a, b, fa, fb, sa, sb = h[:, self.i], h[:, self.j], f[:, self.i], f[:, self.j], s[:, self.i], s[:, self.j]
            product = a * b
            error = ((fa * fb - product) + fa * sb + sa * fb) + sa * sb
            error += a * l_[:, self.j] + b * l_[:, self.i]
            made = dd_add((self.sum[0][:n], self.sum[1][:n]), (product, error))
            self.sum[0][:n], self.sum[1][:n] = made

    def total(self) -> Pair:
        found = (self.sum[0][0], self.sum[1][0])
        for k in range(1, self.lanes):
            found = dd_add(found, (self.sum[0][k], self.sum[1][k]))
        return found


# ---- the eigenproblem


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, off-diagonal, q) with a = q t q' by Householder reflections."""
    a, n = a.copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        size = np.linalg.norm(v)
        if size == 0:
            continue
        v[0] += size if v[0] >= 0 else -size
        v /= np.linalg.norm(v)
        a[k + 1 :, :] -= 2 * np.outer(v, v @ a[k + 1 :, :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), q


def rank_one(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of diag(d) + rho z z', rho > 0."""
    n = len(d)
    order = np.argsort(d, kind="stable")
    d, z = d[order], z[order].copy()
    turn = np.eye(n)[order].T  # columns: the basis in which the problem is stated
    tiny = 8 * np.finfo(float).eps * max(np.abs(d).max(), rho * float(z @ z))
    live, last = [], None
    for k in range(n):
        if rho * abs(z[k]) * np.linalg.norm(z) <= tiny:
            z[k] = 0.0
            continue
        if last is not None and (d[k] - d[last]) * abs(z[k] * z[last]) <= tiny * (z[k] ** 2 + z[last] ** 2):
            r = np.hypot(z[k], z[last])
            c, s = z[k] / r, z[last] / r
            z[k], z[last] = r, 0.0
            a, b = turn[:, k].copy(), turn[:, last].copy()
            turn[:, k], turn[:, last] = c * a + s * b, c * b - s * a
            da, db = d[k], d[last]
            d[k], d[last] = c * c * da + s * s * db, c * c * db + s * s * da
            live.pop()
        live.append(k)
        last = k
    values, vectors = d.copy(), turn
    if live:
        own, w = d[live], z[live]
        ascending = np.argsort(own, kind="stable")
        live, own, w = np.array(live)[ascending], own[ascending], w[ascending]
        m, squares = len(own), rho * w * w
        width = np.append(np.diff(own), squares.sum())
        at_middle = 1 + (squares / (own - (own + width / 2)[:, None])).sum(axis=1)
        right = at_middle < 0
        right[-1] = False
        origin = np.where(right, np.minimum(np.arange(m) + 1, m - 1), np.arange(m))
        poles = own - own[origin][:, None]  # row: root, column: pole, from the root's origin
        low = np.where(right, -width / 2, 0.0)
        high = np.where(right, 0.0, np.where(np.arange(m) == m - 1, width * (1 + 1e-15), width / 2))
        for _ in range(120):
            middle = (low + high) / 2
            with np.errstate(divide="ignore", over="ignore"):
                above = 1 + (squares / (poles - middle[:, None])).sum(axis=1) > 0
            low, high = np.where(above, low, middle), np.where(above, middle, high)
        root = (low + high) / 2
        root = np.where(root == 0, np.where(right, -np.finfo(float).tiny, np.finfo(float).tiny), root)
        gap = root[:, None] - poles  # root j less pole i
        weights = np.empty(m)
        for i in range(m):
            others = np.concatenate([gap[:i, i] / (own[:i] - own[i]), gap[i : m - 1, i] / (own[i + 1 :] - own[i])])
            weights[i] = np.sqrt(max(np.prod(others) * gap[m - 1, i] / rho, 0.0)) * np.sign(w[i])
        inner = weights[None, :] / -gap
        inner /= np.linalg.norm(inner, axis=1, keepdims=True)
        values[live] = own[origin] + root
        vectors = turn.copy()
        vectors[:, live] = turn[:, live] @ inner.T
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


def divide_and_conquer(d: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and vectors of a symmetric tridiagonal matrix."""
    n = len(d)
    if n == 1:
        return d.copy(), np.ones((1, 1))
    m, rho = n // 2, float(e[n // 2 - 1])
    left, right = d[:m].copy(), d[m:].copy()
    left[-1] -= abs(rho)
    right[0] -= abs(rho)
    (d1, q1), (d2, q2) = divide_and_conquer(left, e[: m - 1]), divide_and_conquer(right, e[m:])
    q = np.zeros((n, n))
    q[:m, :m], q[m:, m:] = q1, q2
    both = np.concatenate([d1, d2])
    if rho == 0:
        order = np.argsort(both, kind="stable")
        return both[order], q[:, order]
    values, vectors = rank_one(both, np.concatenate([q1[-1], np.sign(rho) * q2[0]]), abs(rho))
    return values, q @ vectors


def eigen(high: np.ndarray, low: np.ndarray, steps: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit vectors (columns) of the symmetric matrix high + low."""
    size = float(np.abs(high).max())
    if size == 0:
        return np.zeros(len(high)), np.eye(len(high))
    d, e, q = tridiagonal(high / size)
    values, inner = divide_and_conquer(d, e)
    x = (q @ inner).astype(np.longdouble)
    a = (high.astype(np.longdouble) + low.astype(np.longdouble)) / size
    norm = float(np.abs(values).max())
    for _ in range(steps):
        r = np.eye(len(a), dtype=np.longdouble) - x.T @ x
        s = x.T @ (a @ x)
        found = np.diag(s) / (1 - np.diag(r))
        near = max(2 * (np.linalg.norm((s - np.diag(found)).astype(float)) + norm * np.linalg.norm(r.astype(float))), norm * 2.0**-56)
        apart = found[None, :] - found[:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            change = np.where(np.abs(apart) > near, (s + found[None, :] * r) / apart, r / 2)
        np.fill_diagonal(change, np.diag(r) / 2)
        x = x + x @ change
    x = x @ (1.5 * np.eye(len(a), dtype=np.longdouble) - x.T @ x / 2)  # vectors of unresolved values at right angles too
    x = x / np.sqrt((x * x).sum(axis=0))
    values = (x * (a @ x)).sum(axis=0) * size
    order = np.argsort(-values, kind="stable")
    values, x = values[order].astype(float), x[:, order].astype(float)
    return values, x * np.where(x[np.abs(x).argmax(axis=0), np.arange(len(a))] < 0, -1.0, 1.0)


# ---- over Spark


def _sound(lists: pa.ListArray, scale: float, offset: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lengths, ok, quantised entries) of a column of vectors; lengths of null ones are -1. The entries are those of all
    lists one after another."""
    lengths = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    c = flat.fill_null(np.nan).to_numpy(zero_copy_only=False).astype(float)
    with np.errstate(invalid="ignore", over="ignore"):
        x = np.floor(scale * c) + offset
        bad = ~(np.abs(x) <= 2.0**52)
    x = np.where(bad, 0.0, x)
    ends = np.cumsum(np.maximum(lengths, 0))
    wrong = np.concatenate([[0], np.cumsum(bad)])
    ok = (lengths > 0) & (wrong[ends] - wrong[ends - np.maximum(lengths, 0)] == 0)
    return lengths, ok, x


def _rows(lists: pa.ListArray, dims: int, scale: float, offset: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions of the sound vectors of that length, their quantised entries)."""
    lengths, ok, x = _sound(lists, scale, offset)
    chosen = ok & (lengths == dims)
    starts = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
    return np.flatnonzero(chosen), x[starts[chosen][:, None] + np.arange(dims)]


def _sums(vectors: DataFrame, scale: float, offset: int) -> tuple[int, list[int]]:
    """(n, exact sum of every dimension) over the sound vectors of the commonest length; (0, []) where there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            lengths, ok, _ = _sound(batch.column("v"), scale, offset)
            for dims in np.unique(lengths[ok]):
                _, x = _rows(batch.column("v"), int(dims), scale, offset)
                whole = x.astype(np.int64)
                own = held.setdefault(int(dims), [0, np.zeros(dims, np.int64), np.zeros(dims, np.int64)])
                own[0] += len(x)
                own[1] += (whole >> _HALF).sum(axis=0)
                own[2] += (whole & ((1 << _HALF) - 1)).sum(axis=0)
        for dims, (n, high, low) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(dims, dims, np.int32)), pa.array(np.arange(dims, dtype=np.int32)), pa.array(np.full(dims, n, np.int64)), pa.array(high), pa.array(low)], names=["dims", "k", "n", "high", "low"])

    parts = vectors.mapInArrow(run, "dims int, k int, n long, high long, low long")
    sums = parts.groupBy("dims", "k").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low"))
    best = sums.filter("k = 0").orderBy(F.desc("n"), "dims").select("dims", "n").first()  # one row per length
    if best is None:
        return 0, []
    found = sums.filter(F.col("dims") == best.dims).orderBy("k").collect()  # one row per dimension
    return best.n, [(r.high << _HALF) + r.low for r in found]


class Fit:
    """What the rows need: the mean as a double-double, the components and how they are scaled."""

    def __init__(self, n: int, sums: list[int], scale: float, offset: int):
        self.n, self.sums, self.scale, self.offset = n, sums, scale, offset
        exact = [Fraction(s, n) for s in sums]
        self.mean = np.array([float(x) for x in exact])
        self.rest = np.array([float(x - Fraction(m)) for x, m in zip(exact, self.mean.tolist(), strict=True)])

    def centred(self, x: np.ndarray) -> Pair:
        high, error = two_sum(x, -self.mean[None, :])
        return two_sum(high, error - self.rest[None, :])

    def solve(self, high: np.ndarray, low: np.ndarray, components: int) -> None:
        values, vectors = eigen(high / self.n, low / self.n)
        trace = float(np.trace(high) + np.trace(low)) / self.n
        k = min(components, len(values))
        live = values[:k] > max(values[0], 0.0) * len(values) * 2.0**-50
        self.live, self.vectors = live, vectors[:, :k]
        self.scales = np.where(live, 1 / np.sqrt(np.where(live, values[:k], 1.0)), np.nan)
        self.explained = values[:k] / trace if trace > 0 else np.full(k, np.nan)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (self.centred(x)[0] @ self.vectors) * self.scales

    def deviation(self, x: np.ndarray) -> pa.Array:
        """The exact sum over dimensions of (n x - S)**2; null beyond 64 bits."""
        whole, most = x.astype(np.int64), max(map(abs, self.sums))
        far = float(self.n) * float(np.abs(whole).max(initial=0)) + float(most)
        if far < 2.0**62:
            y = self.n * whole - np.array(self.sums)
            if len(self.sums) * float(np.abs(y).max(initial=0)) ** 2 < 2.0**62:
                return pa.array((y * y).sum(axis=1))
        y = self.n * whole.astype(object) - np.array(self.sums, dtype=object)
        return pa.array([None if v >= 1 << 63 else v for v in (y * y).sum(axis=1).tolist()], pa.int64())


def _merged(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Add the double-double parts of equal keys, one row held per key."""
    schema = parts.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Pair] = {}
        for batch in batches:
            names = list(zip(*(batch.column(k).to_pylist() for k in ("block", "salt")), strict=True))
            for i, name in enumerate(names):
                own = tuple(batch.column(c)[i].values.to_numpy() for c in ("high", "low"))
                held[name] = dd_add(held[name], own) if name in held else own
        for (block, salt), (high, low) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([salt], pa.int32()), pa.array([high], pa.list_(pa.float64())), pa.array([low], pa.list_(pa.float64()))], names=["block", "salt", "high", "low"])

    return parts.repartition(*keys).mapInArrow(run, schema)


def _covariance(vectors: DataFrame, fit: Fit) -> Pair:
    """The sum of the centred outer products, as two full matrices."""
    dims = len(fit.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        outer, some = Outer(dims), False
        for batch in batches:
            at, x = _rows(batch.column("v"), dims, fit.scale, fit.offset)
            if len(at):
                some = True
                outer.add(*fit.centred(x))
        if some:
            high, low = outer.total()
            for block, start in enumerate(range(0, len(high), _BLOCK)):
                cut = slice(start, start + _BLOCK)
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([high[cut]], pa.list_(pa.float64())), pa.array([low[cut]], pa.list_(pa.float64()))], names=["block", "high", "low"])

    parts = vectors.mapInArrow(run, "block int, high array<double>, low array<double>")
    parts = parts.select("block", (F.spark_partition_id() % _SALTS).cast("int").alias("salt"), "high", "low")
    parts = _merged(parts, ["block", "salt"]).withColumn("salt", F.lit(0))
    found = _merged(parts, ["block"]).orderBy("block").collect()  # the triangle of one matrix
    triangle = [np.concatenate([np.array(r[c]) for r in found]) for c in ("high", "low")]
    out = []
    for half in triangle:
        full = np.zeros((dims, dims))
        full[np.triu_indices(dims)] = half
        out.append(full + np.triu(full, 1).T)
    return out[0], out[1]


def _identity_error(vectors: DataFrame, fit: Fit) -> float | None:
    """The largest entry of the whitened rows' covariance less the identity, over the components with variance."""
    dims, k = len(fit.sums), int(fit.live.sum())
    if k == 0:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((k + 1, k + 1))
        for batch in batches:
            at, x = _rows(batch.column("v"), dims, fit.scale, fit.offset)
            w = np.concatenate([np.ones((len(at), 1)), fit.whitened(x)[:, fit.live]], axis=1)
            held += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(held.size, dtype=np.int32)), pa.array(held.ravel())], names=["at", "value"])

    found = vectors.mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).orderBy("at").collect()
    sums = np.array([r.value for r in found]).reshape(k + 1, k + 1) / fit.n
    covariance = sums[1:, 1:] - np.outer(sums[0, 1:], sums[0, 1:])
    return float(np.abs(covariance - np.eye(k)).max())


def fit(vectors: DataFrame, components: int = 8, column: str = "embedding", scale: float = 1024.0, offset: int = 100_000) -> Fit | None:
    """The whitening of all sound vectors, quantised to floor(scale * c) + offset; None where there are none."""
    own = vectors.select(F.col(column).cast("array<double>").alias("v"))
    n, sums = _sums(own, scale, offset)
    if n == 0:
        return None
    found = Fit(n, sums, scale, offset)
    found.solve(*_covariance(own, found), components)
    found.identity_error = _identity_error(own, found)
    return found


def whiten(vectors: DataFrame, components: int = 8, key: str = "vec_id", column: str = "embedding", scale: float = 1024.0, offset: int = 100_000) -> DataFrame:
    """Per sound row and component: key, ``component`` (from 1), ``n``, ``deviation``, ``whitened``, ``explained``,
    ``identity_error``."""
    found = fit(vectors, components, column, scale, offset)
    rows = vectors.select(F.col(key), F.col(column).cast("array<double>").alias("__v"))
    numbers = [("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()), ("whitened", T.DoubleType()), ("explained", T.DoubleType()), ("identity_error", T.DoubleType())]
    schema = T.StructType([rows.schema[0], *(T.StructField(k, t) for k, t in numbers)])
    if found is None:
        return vectors.sparkSession.createDataFrame([], schema)
    dims, k = len(found.sums), len(found.explained)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = _rows(batch.column("__v"), dims, scale, offset)
            each = np.repeat(at, k)
            value = lambda v: pa.array(v, pa.float64(), from_pandas=True)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                    pa.array(np.full(len(each), found.n, np.int64)),
                    found.deviation(x).take(pa.array(np.repeat(np.arange(len(at)), k))),
                    value(found.whitened(x).ravel()),
                    value(np.tile(found.explained, len(at))),
                    value(np.full(len(each), np.nan if found.identity_error is None else found.identity_error)),
                ],
                names=[key, *(name for name, _ in numbers)],
            )

    return rows.mapInArrow(run, schema)
