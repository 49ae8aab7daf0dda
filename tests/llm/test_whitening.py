import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonara.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, x string, id string, component string, n string, k string"


def table(spark, vectors, first=0):
    return spark.createDataFrame([(first + k, None if v is None else [None if c is None else float(c) for c in v], *["y"] * 5) for k, v in enumerate(vectors)], SCHEMA).repartition(3)


def brute(vectors):
    """numpy's eigenpairs of the whole covariance, in the contract's fixed point."""
    x = np.floor(64 * np.asarray(vectors, dtype=np.float32).astype(float)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    c = (n * x - sums) / n
    values, vectors_ = np.linalg.eigh(c.T @ c / n)
    return x, n, sums, c, values[::-1], vectors_[:, ::-1]


def check(spark, vectors, most, rows):
    x, n, sums, c, values, directions = brute(vectors)
    found = rows.collect()
    count = min(most, x.shape[1])
    assert len(found) == len(x) * count
    w = np.zeros((len(x), count))
    for r in found:
        k = r.component - 1
        w[r.vec_id, k] = r.whitened
        assert r.n == n and r.deviation == int(((n * x[r.vec_id] - sums) ** 2).sum())
        assert math.isclose(r.explained, values[k] / values.sum(), rel_tol=1e-9)
        assert r.identity_error <= 1e-9
    want = c @ directions[:, :count] / np.sqrt(values[:count])
    signs = np.sign((w * want).sum(axis=0))
    assert np.abs(w - want * signs).max() < 1e-6


def spectrum(rows, size, fall, seed=5):
    rng = np.random.default_rng(seed)
    return rng.standard_normal((rows, size)) * (4 * fall ** np.arange(size)) @ np.linalg.qr(rng.standard_normal((size, size)))[0] + 3


def test_flat_spectrum_takes_the_full_dimension(spark):
    vectors = np.random.default_rng(1).standard_normal((700, 24)).astype(np.float32)
    df = table(spark, vectors)
    fitted = whitening.fit(whitening.fixed_point(df), most=8, oversampling=4, passes=2)
    assert fitted.full and fitted.passes == 3
    check(spark, vectors, 8, whitening.whitening_rows(df, most=8))


def test_falling_spectrum_ends_with_a_thin_basis(spark):
    vectors = (spectrum(600, 40, 0.3) * 40).astype(np.float32)
    fitted = whitening.fit(whitening.fixed_point(table(spark, vectors)), most=3, passes=12, oversampling=8)
    assert not fitted.full and fitted.passes < 12
    _, _, _, _, values, directions = brute(vectors)
    assert np.allclose(fitted.eigenvalues, values[:3], rtol=1e-11)
    assert np.allclose(np.abs((fitted.components * directions[:, :3]).sum(axis=0)), 1, atol=1e-11)


def test_incomplete_vectors_are_dropped_and_repeated_ones_count(spark):
    sound = np.random.default_rng(2).standard_normal((60, 5)).astype(np.float32).tolist()
    sound += sound[:7]
    odd = [None, [], [1.0] * 4, [1.0, None, 0.0, 0.0, 0.0], [float("nan")] + [0.0] * 4, [float("inf")] + [0.0] * 4, [0.0] * 4 + [float("-inf")]]
    df = table(spark, sound).union(table(spark, odd, 1000)).union(table(spark, odd, 1000))
    check(spark, sound, 32, whitening.whitening_rows(df))


def test_null_ids_and_equal_ids(spark):
    df = spark.createDataFrame([(None, [1.0, 2.0]), (1, [0.0, 1.0]), (1, [2.0, -1.0]), (1, [2.0, -1.0])], "vec_id bigint, embedding array<double>")
    rows = whitening.whitening_rows(df).collect()
    assert len(rows) == 8 and {r.n for r in rows} == {4} and sum(r.vec_id is None for r in rows) == 2


def test_component_without_variance_is_zero(spark):
    rows = whitening.whitening_rows(table(spark, [[1.0, 5.0, 0.0], [2.0, 5.0, 0.0], [4.0, 5.0, 0.0]])).collect()
    assert all(r.whitened == 0 and r.explained < 1e-15 for r in rows if r.component > 1)
    assert all(abs(r.explained - 1) < 1e-12 and r.identity_error < 1e-12 for r in rows if r.component == 1)
    assert all(r.whitened == 0 and r.deviation == 0 and r.explained == 0 and r.identity_error == 0 for r in whitening.whitening_rows(table(spark, [[1.0, 2.0]])).collect())


@pytest.mark.parametrize("vectors", [[], [None], [[]], [[None, 1.0]]])
def test_no_complete_vector_gives_no_rows(spark, vectors):
    assert whitening.whitening_rows(table(spark, vectors)).count() == 0


def test_deviation_beyond_long_is_an_error_and_not_a_wrong_number():
    x = np.array([[10**6, 10**6 + 1], [3 * 10**9, 7]], dtype=np.int64)
    assert whitening.squared_deviations(x, 1, x[0]).tolist() == [0, (3 * 10**9 - 10**6) ** 2 + (10**6 - 6) ** 2]
    with pytest.raises(OverflowError):
        whitening.squared_deviations(x * 3, 2, x[0])
    with pytest.raises(OverflowError):
        whitening.exact_deviations(x, 1 << 40, x[0])


def test_sums_do_not_depend_on_partitions(spark):
    vectors = np.random.default_rng(3).standard_normal((900, 6)).astype(np.float32)
    x = whitening.fixed_point(table(spark, vectors))
    one, many = (whitening.fit(x.repartition(k)) for k in (1, 40))
    assert one.n == many.n and (one.sums == many.sums).all() and np.allclose(one.eigenvalues, many.eigenvalues, rtol=1e-13)
    assert whitening.fixed_point(table(spark, vectors)).agg(F.count("*")).first()[0] == 900
