"""Decompositions in the plan against numpy, repeatable draws, and the spectra whose bias is known."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import matrices as M
from tidemark.operators import eigen as EI


def spd(seed, k):
    x = np.random.default_rng(seed).normal(size=(k, 2 * k)) * np.exp(np.random.default_rng(seed + 1).normal(size=(k, 1)))
    return x @ x.T


@pytest.mark.parametrize("k", [1, 2, 3, 6])
def test_jacobi_equals_numpy(spark, k):
    cases = [spd(s, k) for s in range(4)] + [np.eye(k), np.zeros((k, k)), np.diag(np.arange(k)[::-1].astype(float)), -spd(9, k)]
    rows = spark.createDataFrame([(n, m.ravel().tolist()) for n, m in enumerate(cases)] + [(99, None)], "n int, m array<double>")
    got = {r.n: r.e for r in rows.select("n", EI.jacobi(F.col("m"), k).alias("e")).collect()}
    assert got.pop(99) is None
    for n, m in enumerate(cases):
        values = np.array([x.value for x in got[n]])
        vectors = np.array([x.vector for x in got[n]]).T
        np.testing.assert_allclose(values, np.linalg.eigvalsh(m), atol=1e-10 * max(1, np.abs(m).max()))
        np.testing.assert_allclose(m @ vectors, vectors * values, atol=1e-9 * max(1, np.abs(m).max()))
        np.testing.assert_allclose(vectors.T @ vectors, np.eye(k), atol=1e-12)


@pytest.mark.parametrize("k", [2, 4])
def test_clip_and_adjustment_equal_the_kernels(spark, k):
    flat = np.outer(np.arange(1, k + 1), np.arange(1, k + 1)).astype(float)  # of rank one
    cases, bias = [spd(5, k), flat], np.linspace(1.3, 0.8, k)
    rows = spark.createDataFrame([(n, m.ravel().tolist(), bias.tolist()) for n, m in enumerate(cases)], "n int, m array<double>, b array<double>")
    for r in rows.select("n", EI.clipped(F.col("m"), k).alias("c"), EI.adjusted(F.col("m"), F.col("b"), 1.4, k).alias("a")).collect():
        np.testing.assert_allclose(np.reshape(r.c, (k, k)), M.positive(cases[r.n]), rtol=1e-9, atol=1e-10)
        np.testing.assert_allclose(np.reshape(r.a, (k, k)), M.eigen_adjusted(cases[r.n], bias, 1.4), rtol=1e-9, atol=1e-9)
    assert np.linalg.eigvalsh(np.reshape(r.c, (k, k))).min() > 0


def test_draws_are_hashes_and_normal(spark):
    rows = spark.range(40_000).repartition(7).select("id", EI.normal(3, F.col("id"), F.lit(1)).alias("z"))
    z = {r.id: r.z for r in rows.collect()}
    for k in (0, 17, 39_999):
        h = hashlib.md5(f"3:{k}:1".encode()).hexdigest()
        u, v = int(h[:12], 16), int(h[12:24], 16)
        assert z[k] == pytest.approx(math.sqrt(-2 * math.log((u + 1) / 16**12)) * math.cos(2 * math.pi * v / 16**12), rel=1e-12)
    x = np.array([z[k] for k in range(40_000)])
    assert abs(x.mean()) < 0.02 and abs(x.std() - 1) < 0.02 and abs((x**3).mean()) < 0.06 and abs((x**4).mean() - 3) < 0.15
    assert abs(np.corrcoef(x[1:], x[:-1])[0, 1]) < 0.02


def test_moments_are_those_of_the_draws(spark):
    decay = 0.97
    got = {r.simulation: np.reshape(r.s, (3, 3)) for r in EI.draw_moments(spark, 3, seed=5, simulations=4, window=50, decay=decay).collect()}
    w = decay ** np.arange(50)[::-1]
    w /= w.sum()
    draw = spark.range(4 * 50 * 3).select("id", EI.normal(5, F.floor(F.col("id") / 150), F.floor(F.col("id") / 3) % 50, F.col("id") % 3).alias("z")).orderBy("id").collect()
    z = np.array([r.z for r in draw]).reshape(4, 50, 3)
    for n in range(4):
        x = z[n] - w @ z[n]
        np.testing.assert_allclose(got[n], (x * w[:, None]).T @ x / (1 - w @ w), rtol=1e-9)
    with pytest.raises(ValueError):
        EI.draw_moments(spark, 3, seed=1, simulations=2, window=3, decay=decay)


def test_known_spectra(spark):
    """18 factors, span 250, window 750, 200 simulations: equal variances give 1.31 to 0.80, spread ones 1.10 to 0.99."""
    k = 18
    rows = EI.draw_moments(spark, k, seed=0, simulations=200, window=750, decay=1 - 2 / 251).collect()
    s = np.array([r.s for r in rows]).reshape(-1, k, k)
    for spectrum, low, high in ((np.ones(k), 1.31, 0.80), (np.geomspace(1e-3, 1, k), 1.10, 0.99)):
        size = np.sqrt(spectrum)
        v = M.bias_of(spectrum, s * np.outer(size, size))
        assert v[0] == pytest.approx(low, abs=0.015) and v[-1] == pytest.approx(high, abs=0.01)


def test_bias_in_the_plan_equals_the_kernel(spark):
    spectra = [(1, [0.2, 1.5, 2.0]), (2, [1.0, 1.0, 1.0])]
    moments = EI.draw_moments(spark, 3, seed=2, simulations=30, window=80, decay=0.98)
    s = np.array([r.s for r in moments.collect()]).reshape(-1, 3, 3)
    for r in EI.simulated_bias(spark.createDataFrame(spectra, "key int, spectrum array<double>"), moments, 3).collect():
        spectrum = np.array(dict(spectra)[r.key])
        np.testing.assert_allclose(r.bias, M.bias_of(spectrum, s * np.outer(np.sqrt(spectrum), np.sqrt(spectrum))), rtol=1e-9)
