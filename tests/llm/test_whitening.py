"""Whitening against numpy's eigenvectors; exact polynomials and roots; repeated eigenvalues; odd vectors."""

import math
from fractions import Fraction

import numpy as np
import pytest

from strider.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>"


def rows_of(spark, rows, schema=SCHEMA, **kw):
    df = spark.createDataFrame(rows, schema).selectExpr("*", "1 as n", "2 as x", "3 as component").repartition(4)
    return W.whiten(df, **kw).collect()


def brute(vectors):
    x = np.array([[math.floor(64 * float(c)) for c in v] for v in vectors], float)
    fit = np.unique(x, axis=0)
    y = fit - fit.mean(axis=0)
    values, vectors = np.linalg.eigh(y.T @ y / len(fit))
    return x, fit, values[::-1], vectors[:, ::-1].T


def test_equals_numpy(spark):
    rng = np.random.default_rng(1)
    data = (rng.standard_normal((300, 20)) * np.linspace(0.2, 3, 20)).astype(np.float32)
    data[290:] = data[0]
    out = rows_of(spark, [(i, v.tolist()) for i, v in enumerate(data)])
    x, fit, values, vectors = brute(data)
    assert len(out) == 300 * 16 and {r.n for r in out} == {len(fit)}
    assert out[0].identity_error < 1e-12
    z = np.zeros((300, 16))
    for r in out:
        z[r.vec_id, r.component - 1] = r.whitened
        assert abs(r.explained / (values[r.component - 1] / values.sum()) - 1) < 1e-9
    want = (x - fit.mean(axis=0)) @ vectors[:16].T / np.sqrt(values[:16])
    assert np.abs(np.abs(z) - np.abs(want)).max() < 1e-8
    exact = [[len(fit) * (int(c) + W.SHIFT) - int(s) - len(fit) * W.SHIFT for c, s in zip(v, fit.sum(axis=0), strict=True)] for v in x]
    assert {(r.vec_id, int(r.deviation)) for r in out} == {(i, sum(c * c for c in v)) for i, v in enumerate(exact)}


@pytest.mark.parametrize("d", [1, 2, 3, 7, 12])
def test_polynomial_and_roots_are_exact(spark, d):
    rng = np.random.default_rng(d)
    a = rng.integers(-50, 50, (d + 2, d)).astype(object)
    matrix = (a.T @ a).tolist()
    symmetric = W.characteristic_polynomial(spark, matrix)
    # Faddeev and Leverrier's way, in fractions.
    m, c, want = [[Fraction(0)] * d for _ in range(d)], Fraction(1), [Fraction(1)]
    exact = np.array(matrix, object)
    eye = np.array([[Fraction(i == j) for j in range(d)] for i in range(d)], object)
    m = eye * 0
    for k in range(1, d + 1):
        m = exact.dot(m) + eye * c
        c = -sum(exact.dot(m)[i, i] for i in range(d)) / k
        want.append(c * (-1) ** k)
    assert symmetric == [int(x) for x in want]
    roots = W.largest_roots(symmetric, 16)
    assert np.allclose([float(r) for r in roots], np.linalg.eigvalsh(np.array(matrix, float))[::-1], rtol=1e-8)


def test_repeated_and_zero_eigenvalues(spark):
    # Eigenvalues 9, 4, 4, 4, 1, 1 and two zeros after a turn by Hadamard's matrix.
    h = np.array([[1]], object)
    for _ in range(3):
        h = np.block([[h, h], [h, -h]])
    values = [9, 4, 4, 4, 1, 1, 0, 0]
    matrix = h.dot(np.diag(values).astype(object)).dot(h.T).tolist()
    roots = W.largest_roots(W.characteristic_polynomial(spark, matrix), 16)
    assert np.allclose([float(r) for r in roots], [72, 32, 32, 32, 8, 8], rtol=1e-15)
    v = W.eigenvectors(matrix, roots)
    assert np.abs(v @ v.T - np.eye(6)).max() < 1e-15
    assert np.abs(np.array(matrix, float) @ v.T - v.T * [float(r) for r in roots]).max() < 1e-12
    assert len(W.largest_roots(W.characteristic_polynomial(spark, matrix), 3)) == 3


def test_hessenberg_with_zero_pivots():
    p = 1009
    a = np.array([[0, 0, 3, 1], [0, 0, 0, 2], [1, 0, 0, 0], [0, 5, 0, 0]], np.int64)
    h = W.hessenberg(a, p)
    assert not np.tril(h, -2).any()
    assert W.polynomial_mod(a, p) == [int(round(c)) % p for c in np.poly(a.astype(float))]


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.5, 1.0]), (2, [1.5, -1.0]), (2, [1.5, -1.0]), (None, [0.25, 3.0]), (3, [-2.0, 0.0])]
    bad = [(4, None), (5, []), (6, [nan, 1.0]), (7, [None, 1.0]), (8, [inf, 1.0]), (9, [1.0, 2.0, 3.0]), (10, [3e38, 0.0])]
    out = rows_of(spark, good + bad)
    assert sorted((r.vec_id or 0, r.component) for r in out) == sorted((i or 0, k) for i, _ in good for k in (1, 2))
    assert {r.n for r in out} == {4} and out[0].identity_error < 1e-12


def test_few_vectors_and_empty_tables(spark):
    assert rows_of(spark, []) == []
    assert rows_of(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []
    out = rows_of(spark, [(1, [1.0, 2.0, 0.0]), (2, [1.0, 3.0, 0.0])])
    assert [(r.component, abs(r.whitened), r.explained) for r in out] == [(1, 1.0, 1.0)] * 2


def test_huge_entries_stay_exact(spark):
    rows = [(1, [1e15, 1.0]), (2, [-1e15, 2.0]), (3, [0.0, -5.0])]
    out = rows_of(spark, rows, "vec_id long, embedding array<double>")
    x = [[math.floor(64 * c) for c in v] for _, v in rows]
    s = [sum(c) for c in zip(*x, strict=True)]
    assert {(r.vec_id, int(r.deviation)) for r in out} == {(i + 1, sum((3 * c - t) ** 2 for c, t in zip(v, s, strict=True))) for i, v in enumerate(x)}
    assert out[0].identity_error < 1e-4
