import math
from fractions import Fraction

import numpy as np
import pytest

from rivulet.llm import whitening


def exact_covariance(rows):
    n, sums = len(rows), [sum(c) for c in zip(*rows, strict=True)]
    centred = [[n * x - s for x, s in zip(r, sums, strict=True)] for r in rows]
    return [[Fraction(sum(r[i] * r[j] for r in centred), n**3) for j in range(len(sums))] for i in range(len(sums))]


@pytest.mark.parametrize("seed,n,kind", [(1, 1, "random"), (2, 2, "random"), (3, 33, "random"), (4, 40, "repeated"), (5, 30, "graded"), (6, 24, "zero")])
def test_eigen_solve(seed, n, kind):
    rng = np.random.default_rng(seed)
    q, _ = np.linalg.qr(rng.normal(size=(n, n)))
    values = {"random": rng.normal(size=n), "repeated": rng.integers(0, 4, n).astype(float), "graded": 10.0 ** -np.arange(n), "zero": np.zeros(n)}[kind]
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    d, e, h = whitening.tridiagonal(a)
    t = np.diag(d) + np.diag(e, 1) + np.diag(e, -1)
    assert np.abs(h @ t @ h.T - a).max() < 1e-13
    found, inner = whitening.divide_and_conquer(d, e)
    assert np.abs(found - np.linalg.eigvalsh(a)).max() < 1e-13 and np.abs(inner.T @ inner - np.eye(n)).max() < 1e-12
    assert np.abs(t @ inner - inner * found).max() < 1e-13
    got, x = whitening.eigen(a, np.zeros_like(a))
    assert np.abs(got - np.sort(values)[::-1]).max() < 1e-13 and np.abs(x.T @ x - np.eye(n)).max() < 1e-14


def test_outer_products_are_exact_to_double_double():
    rng = np.random.default_rng(7)
    rows = (rng.integers(-5, 5, (500, 5)) + rng.integers(0, 2, (500, 1)) * 10**9 + 10**11).tolist()
    fit = whitening.Fit(len(rows), [sum(c) for c in zip(*rows, strict=True)], 1.0, 0)
    outer = whitening.Outer(5)
    outer.add(*fit.centred(np.array(rows, float)))
    high, low = outer.total()
    for i, j, h, l_ in zip(outer.i, outer.j, high, low, strict=True):
        want = exact_covariance(rows)[i][j] * len(rows)
        assert abs((Fraction(float(h)) + Fraction(float(l_)) - want) / want) < Fraction(1, 2**96)


def test_equals_exact_arithmetic(spark):
    rng = np.random.default_rng(11)
    basis = rng.normal(size=(10, 10)) * np.array([3, 2.9, 2, 1, 0.5, 0.2, 0.1, 0.05, 0.01, 0.001])[:, None]
    v = (rng.normal(size=(300, 10)) @ basis + 40).astype(np.float32).tolist()
    rows = [(i, x) for i, x in enumerate(v)] + [(900, v[0]), (None, v[1]), (901, None), (902, []), (903, v[2][:9]), (904, [math.nan] + v[3][1:]), (905, [math.inf] + v[3][1:]), (906, [None] + v[4][1:]), (907, [1e30] + v[4][1:])]
    sound = [(k, [math.floor(1024 * c) + 100_000 for c in x]) for k, x in rows if x and len(x) == 10 and k not in range(903, 908)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    made = whitening.whiten(table)
    assert made.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    made = made.collect()
    n, sums = len(sound), [sum(c) for c in zip(*(x for _, x in sound), strict=True)]
    cov = exact_covariance([x for _, x in sound])
    values, vectors = np.linalg.eigh(np.array([[float(c) for c in r] for r in cov]))
    values, vectors = values[::-1][:8], vectors[:, ::-1][:, :8]
    want = {(k, sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))): (np.array([float(Fraction(n * c - s, n)) for c, s in zip(x, sums, strict=True)]) @ vectors / np.sqrt(values)) for k, x in sound}
    assert len(made) == 8 * n and {r.n for r in made} == {n} and {r.identity_error for r in made} == {made[0].identity_error} and made[0].identity_error < 1e-9
    trace = sum(float(cov[i][i]) for i in range(10))
    signs = {}
    for r in made:
        assert r.explained == pytest.approx(values[r.component - 1] / trace, rel=1e-9)
        w = want[r.vec_id, r.deviation][r.component - 1]
        signs.setdefault(r.component, r.whitened * w > 0)
        assert r.whitened == pytest.approx(w if signs[r.component] else -w, rel=1e-6, abs=1e-7)


def test_degenerate_tables(spark):
    table = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int")
    assert whitening.whiten(table([])).count() == 0 and whitening.whiten(table([(1, None, 1), (2, [], 1)])).count() == 0
    (one,) = whitening.whiten(table([(1, [0.5], 1)])).collect()
    assert (one.component, one.n, one.deviation, one.whitened, one.explained, one.identity_error) == (1, 1, 0, None, None, None)
    rows = whitening.whiten(table([(1, [1.0, 2.0, 2.0], 1), (2, [3.0, 2.0, 2.0], 1), (3, [1.0, 2.0], 1)])).collect()
    assert {(r.vec_id, r.component, r.deviation) for r in rows} == {(i, c, 2048**2) for i in (1, 2) for c in (1, 2, 3)}
    assert {abs(r.whitened) for r in rows if r.component == 1} == {1.0} and {r.whitened for r in rows if r.component > 1} == {None}
    far = whitening.whiten(table([(1, [1e12], 1), (2, [-1e12], 1)])).collect()
    assert [r.deviation for r in far] == [None, None] and all(abs(abs(r.whitened) - 1) < 1e-9 for r in far)
