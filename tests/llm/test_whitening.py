"""Whitening against a library's eigenvectors and exact integers; the eigenproblem on hard matrices."""

import math

import numpy as np
import pytest

from freshet.llm import whitening
from freshet.llm.queries import QUERIES
from tests.conftest import SF

SCHEMA = "vec_id long, embedding array<float>, x int, n int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], SCHEMA)


def hard_matrices():
    draw = np.random.default_rng(3)
    basis = np.linalg.qr(draw.standard_normal((24, 24)))[0]
    for values in ([5.0] * 8 + [5 + 1e-9] * 4 + [1.0] * 12, np.geomspace(1e9, 1e-3, 24), [7.0] + [0.0] * 23, np.arange(24.0)):
        yield (basis * np.array(values)) @ basis.T
    yield np.eye(10)
    yield np.diag([3.0, 1.0, 2.0, 3.0, 3.0])
    yield np.array([[2.0]])
    yield np.array([[2.0, 1.0], [1.0, 2.0]])
    yield np.zeros((4, 4))


@pytest.mark.parametrize("matrix", [*hard_matrices()])
def test_components_of_hard_matrices(matrix):
    matrix = (matrix + matrix.T) / 2
    k = min(16, len(matrix))
    values, vectors = whitening.leading_components(matrix, k)
    norm = max(np.abs(matrix).max(), 1e-300)
    assert np.allclose(values, np.linalg.eigvalsh(matrix)[::-1][:k], rtol=0, atol=1e-13 * norm * len(matrix))
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12
    assert np.abs(matrix @ vectors - vectors * values).max() < 1e-12 * norm * len(matrix)


def test_sturm_counts():
    diagonal, off = np.array([2.0, 0.0, 1.0, 5.0]), np.array([1.0, 0.0, 2.0])
    values = np.linalg.eigvalsh(np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1))
    at = np.array([-9.0, *(values + 1e-6), 99.0])
    assert whitening.count_below(diagonal, off, at).tolist() == [0, 1, 2, 3, 4, 4]


def brute(rows, components=16):
    """Every defined number, from plain integers and a library's solver."""
    used = [(i, [math.floor(64 * np.float64(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in used}), dtype=object)
    n, sums = len(fit), [sum(c) for c in fit.T]
    centred = np.array([[float(a - s // n) - (s % n) / n for a, s in zip(x, sums)] for x in fit])
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    whitened = {i: np.array([float(a - s // n) - (s % n) / n for a, s in zip(x, sums)]) @ vectors / np.sqrt(values) for i, x in used}
    return n, {i: sum((n * a - s) ** 2 for a, s in zip(x, sums)) for i, x in used}, whitened, values / np.trace(covariance)


def held(got, rows, components=16):
    n, deviation, whitened, explained = brute(rows, components)
    assert {(r.vec_id, r.component) for r in got} == {(i, c) for i in whitened for c in range(1, len(explained) + 1)}
    signs = {}
    for r in got:
        want = whitened[r.vec_id][r.component - 1]
        assert r.n == n and r.deviation == deviation[r.vec_id] and 0 <= r.identity_error < 1e-9
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-10)
        assert abs(abs(r.whitened) - abs(want)) < 1e-7
        if abs(want) > 1e-3:
            assert signs.setdefault(r.component, r.whitened * want > 0) == (r.whitened * want > 0)


def test_whole_table_against_a_library(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    held(QUERIES["op12_whitening"](spark, SF).collect(), rows)


def test_odd_rows_and_repeats(spark):
    draw = np.random.default_rng(5)
    rows = [(k, draw.standard_normal(4).astype(np.float32).tolist()) for k in range(40)]
    rows += [(100 + k, rows[3][1]) for k in range(30)]  # a repeated vector counts once
    odd = [(200, None), (201, [1.0, None, 0.0, 0.0]), (202, [math.nan, 0.0, 0.0, 0.0]), (203, [0.0, math.inf, 0.0, 0.0]), (204, []), (205, [1.0, 2.0]), (206, [1e30, 0.0, 0.0, 0.0])]
    got = whitening.whiten_embeddings(frame(spark, rows + odd), components=3).collect()
    held(got, rows, 3)


def test_null_and_shared_ids_keep_their_rows(spark):
    rows = [(None, [0.0, 1.0]), (None, [3.0, 1.0]), (5, [1.0, 5.0]), (5, [1.0, 5.0])]
    got = whitening.whiten_embeddings(frame(spark, rows)).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == [(0, 1), (0, 1), (0, 2), (0, 2), (5, 1), (5, 1), (5, 2), (5, 2)]
    assert {r.n for r in got} == {3}


def test_directions_without_variance_have_no_component(spark):
    rows = [(k, [float(k), 2.0 * k, 1.0]) for k in range(10)]
    got = whitening.whiten_embeddings(frame(spark, rows)).collect()
    assert {r.component for r in got} == {1} and all(r.explained == pytest.approx(1) for r in got)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [2.0, 3.0]), (2, [2.0, 3.0])]])
def test_nothing_to_whiten(spark, rows):
    found = whitening.whiten_embeddings(frame(spark, rows))
    assert found.collect() == [] and found.columns == whitening.NAMES


def test_large_deviations_are_exact_or_null():
    fit = whitening.Fit(3, (10, -(2**61)), np.ones(1), np.ones((2, 1)), 1.0)
    x = np.array([[10**9, 0], [5, -(2**40)]])
    want = [sum((3 * a - s) ** 2 for a, s in zip(row, fit.sums)) for row in x.tolist()]
    assert fit.deviations(x) == [v if v < 2**63 else None for v in want]
    small = whitening.Fit(7, (100, -50), np.ones(1), np.ones((2, 1)), 1.0)
    assert small.deviations(x[:1] // 1000) == [(7 * 10**6 - 100) ** 2 + 50**2]
