"""Embedding whitening against exact sums and a full eigendecomposition."""

import math
import random

import numpy as np
import pytest

from checkwise.llm import whitening


def _brute(rows, components=4, scale=256):
    """{(id, component): (n, deviation, |whitened|, explained)} and the usable ids."""
    good = [(i, [math.floor(scale * float(np.float32(c))) for c in v]) for i, v in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    sizes = {}
    for _, x in good:
        sizes[len(x)] = sizes.get(len(x), 0) + 1
    d = max(sizes, key=lambda k: (sizes[k], k))
    good = [(i, x) for i, x in good if len(x) == d]
    fit = sorted({tuple(x) for _, x in good})
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    y = np.array([[n * a - b for a, b in zip(x, s, strict=True)] for x in fit], float) / n
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1], u[:, ::-1]
    out = []
    for i, x in good:
        row = [n * a - b for a, b in zip(x, s, strict=True)]
        for k in range(min(components, d)):
            if e[k] > 1e-13 * e.sum():
                out.append((i, k + 1, n, sum(c * c for c in row),
                            abs(float(np.array(row, float) / n @ u[:, k])) / math.sqrt(e[k]), e[k] / e.sum()))
    return out


def _table(spark, rows, extra="n"):
    return spark.createDataFrame([(i, v, 1) for i, v in rows], f"vec_id long, embedding array<float>, {extra} int").repartition(5)


def _agree(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3], round(r[4], 6))
    got = sorted(((r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in got), key=key)
    want = sorted(want, key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert np.allclose([r[4] for r in got], [r[4] for r in want], rtol=1e-9, atol=1e-9)
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-10)


def test_whiten_brute(spark):
    g = random.Random(5)
    rows = [(i, [g.gauss(0, 1 + j / 3) + 40 * (j == 2) for j in range(9)]) for i in range(400)]
    rows += [(1000 + i, [0.25] * 9) for i in range(250)]  # one common vector counts once
    rows += [(5, rows[5][1]), (None, [1.0] * 9), (2000, None), (2001, [1.0, None] + [0.0] * 7), (2002, [math.inf] * 9),
             (2003, [math.nan] * 9), (2004, [-0.0] * 9), (2005, [1.0, 2.0]), (2006, [])]
    got = whitening.whiten(_table(spark, rows)).collect()
    _agree(got, _brute(rows))
    error = {r.identity_error for r in got}
    assert len(error) == 1 and 0 <= error.pop() < 1e-9
    for k in range(1, 5):  # one sign for all rows: the mean over the fit list is 0
        by_vector = {r.deviation: r.whitened for r in got if r.component == k}
        assert abs(sum(by_vector.values())) < 1e-6 * len(by_vector)


def test_whiten_far_from_zero(spark):
    """A large offset in every component costs no digits, and deviations beyond 64 bits are null."""
    g = random.Random(6)
    rows = [(i, [float(2**22 + g.randrange(-9, 9)) for _ in range(4)]) for i in range(300)]
    _agree(whitening.whiten(_table(spark, rows)).collect(), _brute(rows))
    rows = [(i, [float(i) * 2.0**40, 1.0]) for i in range(3)]
    assert {r.deviation for r in whitening.whiten(_table(spark, rows)).collect()} >= {None}


def test_whiten_few_components(spark):
    rows = [(i, [float(i), 2.0 * i, 7.0]) for i in range(5)]
    got = whitening.whiten(_table(spark, rows)).collect()
    _agree(got, _brute(rows))
    assert {r.component for r in got} == {1}
    for some in ([], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])], [(1, None)]):
        df = whitening.whiten(_table(spark, some, "component"))
        assert df.collect() == [] and df.columns[:3] == ["vec_id", "component", "n"]


@pytest.mark.parametrize("d", [1, 2, 3, 8, 40])
def test_inertia_and_pairs(d):
    g = np.random.default_rng(d)
    a = g.standard_normal((d, d))
    a = a + a.T
    values = np.linalg.eigvalsh(a)
    for shift in g.uniform(values.min() - 1, values.max() + 1, 20):
        assert whitening.inertia(a, shift) == (values > shift).sum()
    v = a @ a
    values, vectors = np.linalg.eigh(v)
    for k, (value, vector) in enumerate(whitening.leading(v)):
        assert abs(value - values[-1 - k]) <= 1e-12 * values[-1]
        assert abs(abs(vector @ vectors[:, -1 - k]) - 1) < 1e-9


def test_equal_and_close_eigenvalues():
    for diagonal in ([3.0, 3, 3, 1, 0, 0], [5, 5 * (1 + 1e-9), 2, 1], [1, 1, 1, 1, 1], [2, 2 * (1 + 1e-15), 1, 0]):
        q, _ = np.linalg.qr(np.random.default_rng(1).standard_normal((len(diagonal),) * 2))
        v = q @ np.diag(diagonal) @ q.T
        pairs = whitening.leading(v)
        assert np.allclose([e for e, _ in pairs], sorted(diagonal)[::-1][:len(pairs)], rtol=1e-12)
        u = np.stack([x for _, x in pairs])
        assert np.allclose(u @ u.T, np.eye(len(u)), atol=1e-10)
        assert np.allclose(u @ v, np.array([e for e, _ in pairs])[:, None] * u, atol=1e-10)


def test_registered(spark, sf_small, registered):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_small}/embeddings.parquet").collect()]
    _agree(registered["op13_embedding_whitening"](spark, sf_small).collect(), _brute(rows))
