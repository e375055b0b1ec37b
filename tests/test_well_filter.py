import numpy as np
import pytest

from strataspark.operators import spectral as S
from strataspark.operators import well_filter as W

COV = np.array([[1.0, 0.5, 0.1], [0.5, 0.8, -0.1], [0.1, -0.1, 0.6]])


def decays(range_, share):
    return lambda di, dj, dk: share * np.exp(-np.sqrt(di**2 + dj**2 + (dk / range_) ** 2))[..., None, None] * COV


PRIOR, POSTERIOR = decays(3.0, 1.0), decays(2.0, 0.4)


def wells(spark, n=(40, 7)):
    rng, rows = np.random.default_rng(1), []
    for w, size in enumerate(n):
        for k in range(size):
            v = rng.normal(size=3).tolist()
            rows.append((f"w{w}", 5 + k // 10, 3, 2 * k, *(None if rng.random() < 0.1 else x for x in v)))
    return spark.createDataFrame(rows, "well string, i int, j int, k int, a double, b double, c double").repartition(4), rows


def dense(rows):
    """The filter of one well written out block by block."""
    n = len(rows)
    place = np.array([r[1:4] for r in rows], float)
    big = lambda c: np.block([[c(*(np.array([v]) for v in p - q))[0] for q in place] for p in place])
    prior, post = big(PRIOR), big(POSTERIOR)
    post = post + np.diag(1e-4 * np.diag(post) / np.diag(prior))
    a = np.eye(3 * n) - post @ np.linalg.inv(prior + 1e-4 * np.eye(3 * n))
    x = np.array([[v or 0.0 for v in r[4:7]] for r in rows]).ravel()
    return (a @ x).reshape(n, 3), a @ post


VALUES = ["a", "b", "c"]


@pytest.mark.parametrize(("window", "halo"), [(64, 64), (8, 100)])
def test_filter_against_the_dense_one(spark, window, halo):
    df, rows = wells(spark)
    got = {(r.well, r.k): r for r in W.filtered(df, ["well"], ("i", "j", "k"), VALUES, PRIOR, POSTERIOR, window, halo).collect()}
    assert len(got) == len(rows)
    for w in ("w0", "w1"):
        own = [r for r in rows if r[0] == w]
        want, left = dense(own)
        for t, r in enumerate(own):
            g = got[w, r[3]]
            for v, y, z in zip(r[4:7], want[t], (g.a_filtered, g.b_filtered, g.c_filtered), strict=True):
                assert z is None if v is None else z == pytest.approx(y, abs=1e-8)
            part = left[3 * t : 3 * t + 3, 3 * t : 3 * t + 3]
            assert g.error == pytest.approx(((part + part.T) / 2).ravel(), abs=1e-8)


def test_a_narrow_halo_is_near_the_dense_filter(spark):
    df, rows = wells(spark)
    got = {(r.well, r.k): r for r in W.filtered(df, ["well"], ("i", "j", "k"), VALUES, PRIOR, POSTERIOR, 10, 10).collect()}
    want = dense([r for r in rows if r[0] == "w0"])[0]
    off = [abs(got["w0", r[3]].a_filtered - want[t][0]) for t, r in enumerate(x for x in rows if x[0] == "w0") if r[4] is not None]
    assert len(got) == len(rows) and 0 < max(off) < 0.02


def test_mean_error(spark):
    df, _ = wells(spark)
    found = W.filtered(df, ["well"], ("i", "j", "k"), VALUES, PRIOR, POSTERIOR)
    assert W.error_covariance(found) == pytest.approx(np.mean([r.error for r in found.collect()], axis=0).reshape(3, 3))


def test_lags_of_an_inversion(spark):
    """The table of an inversion's posterior covariances is that of the dense solve of test_spectral."""
    from .test_spectral import ANGLES, NX, NY, NZ, correlation, dense, model, traces

    rng, m = np.random.default_rng(1), model()
    d, prior = rng.normal(size=ANGLES * NX * NY * NZ), rng.normal(size=3 * NX * NY * NZ)
    shape = S.Shape(NX, NY, NZ, ANGLES + 4)
    _, cov = S.inverted(traces(spark, d, prior), NX, NY, shape, m, correlation)
    at = W.lag_table(cov, shape, 1, 1)
    left = dense(m, d, prior, True)[1].reshape(3, NX, NY, NZ, 3, NX, NY, NZ)
    for di, dj, dk in ((0, 0, 0), (1, 0, 2), (-1, 1, 3), (1, -1, -2)):
        want = left[:, di % NX, dj % NY, dk % NZ, :, 0, 0, 0]
        assert at(np.array([di]), np.array([dj]), np.array([dk]))[0] == pytest.approx(want, abs=1e-8)
    assert (at(np.array([2]), np.array([0]), np.array([0])) == 0).all()
