"""Whitening against exact fractions and a library's eigenvalues."""

import math
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from pactum.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, x int, n string, component string, deviation int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "n", "c", 1) for i, v in rows], SCHEMA)


def brute(rows):
    """(x of kept rows, n, sums, covariance) in exact arithmetic, divided at the end."""
    kept = [(i, tuple(math.floor(64 * float(c)) + 1_000_000 for c in v)) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({x for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    d = len(sums)
    y = [[n * c - s for c, s in zip(x, sums, strict=True)] for x in fit]
    cov = np.array([[float(Fraction(sum(r[i] * r[j] for r in y), n**3)) for j in range(d)] for i in range(d)])
    return kept, n, sums, cov


def check(got, rows, components=16):
    kept, n, sums, cov = brute(rows)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, len(sums))
    assert Counter((r["vec_id"], r["component"]) for r in got) == Counter((i, c + 1) for i, _ in kept for c in range(k))
    assert {r["n"] for r in got} == {n} and len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9
    deviation, white = {i: sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)) for i, x in kept}, {}
    for r in got:
        assert r["deviation"] == deviation[r["vec_id"]]
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / values.sum(), rel=1e-9)
        white[r["vec_id"], r["component"]] = r["whitened"]
    ids = {i: x for i, x in kept}
    for c in range(k):
        want = {i: float((np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums, strict=True)])) @ vectors[:, c] / math.sqrt(values[c])) for i, x in ids.items()}
        sign = 1 if sum(white[i, c + 1] * w for i, w in want.items()) > 0 else -1
        assert all(white[i, c + 1] == pytest.approx(sign * w, abs=1e-7) for i, w in want.items())


def test_random_vectors(spark):
    rng = np.random.default_rng(4)
    mix = rng.normal(size=(20, 20)) * np.geomspace(30, 0.3, 20)
    rows = [(i, (rng.normal(size=20) @ mix.T).astype(np.float32).tolist()) for i in range(250)]
    rows += [(1000 + i, rows[0][1]) for i in range(100)] + [(2000, None), (2001, [None] + [1.0] * 19), (2002, [float("nan")] * 20), (2003, [float("inf")] + [0.0] * 19), (2004, [-float("inf")] + [0.0] * 19)]
    check(whitening.whiten(frame(spark, rows)).collect(), rows)
    check(whitening.whiten(frame(spark, rows), components=3).collect(), rows, 3)


def test_given_table(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(queries.op13_whitening(spark, sf).collect(), rows)


def test_edges(spark):
    white = lambda rows: whitening.whiten(frame(spark, rows))
    assert white([]).collect() == [] and white([(1, None), (2, [None])]).collect() == []
    assert white([(1, [1.0, 2.0])] * 3).collect() == [] and white([(1, [])]).collect() == []
    got = white([(None, [0.0, 0.0]), (None, [0.0, 0.0]), (1, [1.0, 2.0]), (1, [2.0, 4.0])]).collect()
    # One direction only: the second component has no spread.
    assert Counter((r["vec_id"], r["component"]) for r in got) == Counter({(None, 1): 2, (1, 1): 2})
    assert got[0]["explained"] == pytest.approx(1) and {r["n"] for r in got} == {3}
    with pytest.raises(ValueError):
        white([(1, [1.0]), (2, [1.0, 2.0])])


def test_jacobi_keeps_small_eigenvalues():
    """A graded matrix whose smallest eigenvalue is far under the rounding of its largest."""
    from fractions import Fraction as Q

    scale = [10.0**-k for k in (0, 4, 8, 12)]
    core = np.full((4, 4), 0.3) + np.eye(4)
    a = core * np.outer(scale, scale)
    values, vectors = whitening.jacobi(a)
    m = [[Q(a[i, j]) for j in range(4)] for i in range(4)]
    det = Q(1)
    for i in range(4):
        det *= m[i][i]
        for j in range(i + 1, 4):
            m[j] = [y - m[j][i] / m[i][i] * x for x, y in zip(m[i], m[j], strict=True)]
    assert float(np.prod(values)) == pytest.approx(float(det), rel=1e-12)
    assert np.abs(vectors.T @ vectors - np.eye(4)).max() < 1e-14
    rng = np.random.default_rng(0)
    for d in (1, 2, 7, 64):
        b = rng.normal(size=(d, 2 * d))
        b = b @ b.T
        values, vectors = whitening.jacobi(b)
        assert np.allclose(values, np.linalg.eigvalsh(b)[::-1], rtol=1e-12) and np.abs(b @ vectors - vectors * values).max() < 1e-11 * values[0]
    assert whitening.jacobi(np.diag([1.0, 3.0, 3.0]))[0].tolist() == [3.0, 3.0, 1.0]


def test_large_squares_are_exact():
    assert whitening._squares(np.array([[3 * 10**9, 1], [2, 3]])) == [9 * 10**18 + 1, 13]
