"""Whitening against a dense eigendecomposition."""

import numpy as np
import pytest

from postmill.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n long, body string"


def table(spark, vectors, first=0):
    return spark.createDataFrame([(first + i, v, 0, "clash", 7, "clash") for i, v in enumerate(vectors)], SCHEMA)


def expected(vectors):
    kept = [(i, v) for i, v in enumerate(vectors) if v and all(c is not None and np.isfinite(c) for c in v)]
    x = {i: np.floor(256 * np.array(v, np.float32).astype(np.float64)).astype(np.int64) for i, v in kept}
    fit = np.unique(np.array(list(x.values())), axis=0)
    centred = fit - fit.sum(axis=0) / len(fit)
    values, turn = np.linalg.eigh(centred.T @ centred / len(fit))
    return x, fit, values[::-1], turn[:, ::-1]


def check(rows, vectors, count=4):
    x, fit, values, turn = expected(vectors)
    n, sums = len(fit), fit.sum(axis=0)
    assert len(rows) == count * len(x)
    for k in range(1, count + 1):
        mine = {r.vec_id: r for r in rows if r.component == k}
        assert set(mine) == set(x)
        wanted = {i: float((v - sums / n) @ turn[:, k - 1] / np.sqrt(values[k - 1])) for i, v in x.items()}
        sign = np.sign(sum(wanted[i] * mine[i].whitened for i in x))
        for i, v in x.items():
            assert mine[i].n == n and mine[i].deviation == sum(int(n * a - s) ** 2 for a, s in zip(v.tolist(), sums.tolist()))
            assert mine[i].whitened == pytest.approx(sign * wanted[i], abs=1e-8)
            assert mine[i].explained == pytest.approx(values[k - 1] / values.sum(), rel=1e-10)
            assert mine[i].identity_error < 1e-9 and mine[i].certified


def test_matches_dense_decomposition(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.standard_normal((900, 40)) * np.linspace(0.9, 0.2, 40) + 5).astype(np.float32).tolist()
    vectors += [vectors[0]] * 300 + [None, [], [1.0] * 39 + [None], [float("nan")] * 40, [float("inf")] * 40]
    check(whitening.whiten(table(spark, vectors)).collect(), vectors)


def test_flat_spectrum_grows_the_block(spark):
    """Nearly equal variances: the block grows until few passes are foreseen."""
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal((20000, 36)).astype(np.float32)
    vectors[:, 5] *= 1.3
    blocks = table(spark, vectors[:2000].tolist())
    check(whitening.whiten(blocks).collect(), vectors[:2000].tolist())


def test_fewer_dimensions_than_components(spark):
    check(whitening.whiten(table(spark, [[0.5, 1.0], [1.5, -1.0], [0.25, 3.0], [0.5, 1.0]])).collect(), [[0.5, 1.0], [1.5, -1.0], [0.25, 3.0], [0.5, 1.0]], 2)
    line = [[float(i), 2.0 * i, 1.0] for i in range(5)]
    rows = whitening.whiten(table(spark, line)).collect()
    assert {r.component for r in rows} == {1} and len(rows) == 5


def test_vectors_of_another_length_are_left_out(spark):
    rows = whitening.whiten(table(spark, [[0.5, 1.0], [1.5, -1.0], [0.25, 3.0], [1.0]])).collect()
    assert {r.vec_id for r in rows} == {0, 1, 2}


@pytest.mark.parametrize("vectors", [[], [None], [[1.0, 2.0]], [[1.0, 2.0]] * 3])
def test_nothing_to_whiten(spark, vectors):
    assert whitening.whiten(table(spark, vectors)).collect() == []


def test_deviations_beyond_a_long_are_null():
    centre = whitening.Moments(3, [10**15, 5])
    x = np.array([[10**14, 1], [333333333333334, 2]], np.int64)
    assert whitening._exact_deviation(x, centre) == [None, (3 * 333333333333334 - 10**15) ** 2 + 1]
