import numpy as np
import pytest

from strataspark.operators import prior, wavelets


def ricker(t, peak):
    u = (np.pi * peak * t) ** 2
    return (1 - 2 * u) * np.exp(-u)


def planted(spark, sign=1, noise=0.3, n_wells=12, nz=128, dz=4.0):
    """Wells of different lengths and shifts whose seismic is one wavelet on their reflections, under noise."""
    rng, rows = np.random.default_rng(7), []
    n = 256
    t = (np.minimum(np.arange(n), n - np.arange(n))) * dz / 1000
    wavelet = sign * 50 * ricker(t, 30.0)
    for w in range(n_wells):
        size = int(rng.integers(70, nz))
        r = rng.normal(0, 0.1, size)
        r[0] = 0
        shift = [0, 1, -2, 3][w % 4]
        s = np.fft.irfft(np.fft.rfft(r, n) * np.fft.rfft(np.roll(wavelet, shift)), n)[:size]
        rows.append((f"w{w}", r.tolist(), (s + rng.normal(0, noise, size)).tolist(), shift))
    return spark.createDataFrame([r[:3] for r in rows], "well string, reflections array<double>, seismic array<double>").repartition(3), wavelet, {r[0]: r[3] for r in rows}


@pytest.mark.parametrize("sign", [1, -1])
def test_a_planted_wavelet_is_found_under_noise(spark, sign):
    wells, wavelet, shifts = planted(spark, sign)
    by_well, found = wavelets.estimated(wells, ["well"], 256, 4.0, 200.0, 20.0)
    assert np.corrcoef(found, wavelet)[0, 1] > 0.97 and 0.7 < np.abs(found).max() / 50 < 1.2
    got = {r.well: r.shift / 4.0 for r in by_well.collect()}
    assert all(abs(got[w] - s) < 0.4 for w, s in shifts.items())
    ratios = wavelets.signal_to_noise(wells, by_well, ["well"], found, 4.0).collect()
    assert len(ratios) == 12 and all(r.ratio > 4 and 0.7 < r.scale < 1.5 for r in ratios)


def test_estimation_does_not_depend_on_partitions_and_needs_wells(spark):
    wells, _, _ = planted(spark)
    one, two = (wavelets.estimated(wells.repartition(n), ["well"], 256, 4.0, 200.0, 20.0)[1] for n in (1, 5))
    assert np.allclose(one, two, atol=1e-9)
    with pytest.raises(ValueError, match="no wells"):
        wavelets.estimated(wells.where("false"), ["well"], 256, 4.0, 200.0, 20.0)
    with pytest.raises(Exception, match="doesn't fit"):
        wavelets.estimated(wells, ["well"], 32, 4.0, 200.0, 20.0)


def test_pieces_of_the_estimation():
    x = np.random.default_rng(1).normal(size=64)
    assert np.allclose(wavelets.shifted(x, 5), np.roll(x, 5)) and np.allclose(wavelets.shifted(wavelets.shifted(x, 1.3), -1.3)[1:], x[1:], atol=2)
    w = wavelets.taper(64, 4.0, 80.0)
    assert w[0] == 1 and (w[10:55] == 0).all() and np.allclose(w[1:], w[:0:-1]) and (np.fft.rfft(w).real > -1e-9).all()
    assert abs(wavelets.without_constant(x * w, 4.0, 80.0).sum()) < 1e-9
    cross = np.exp(-((np.arange(64) - 61.3) ** 2) / 8)
    assert wavelets.best_shift(cross, 1, 6) == pytest.approx(-2.7, abs=0.05) and wavelets.best_shift(-cross, 1, 6) == 0
    flat = np.zeros(64)
    flat[[2, 62]] = 1
    assert wavelets.best_shift(flat, 1, 6) == 2


def test_longest_runs_of_wells(spark):
    rows = [(1, k, float(k * k), 1.0 if k not in (3, 8) else None) for k in range(12)] + [(2, 0, 1.0, 1.0), (2, 2, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "well int, k int, e double, s double")
    got = [tuple(r) for r in wavelets.aligned_wells(df, ["well"], "k", "e", "s", 1).collect()]
    assert got == [(1, 4, 4, [0.0, 9.0, 11.0, 13.0], [1.0] * 4)]


def test_auto_covariances_against_loops(spark):
    rng, rows = np.random.default_rng(2), []
    for w in range(5):
        for k in sorted(rng.choice(30, 20, replace=False).tolist()):
            v = rng.normal(size=3).tolist()
            rows.append((w, k, *(None if rng.random() < 0.2 else x for x in v), 1.0 + w))
    df = spark.createDataFrame(rows, "well int, k int, a double, b double, c double, w double")
    got = {(r.lag, r.p, r.q): (r.n, r.weight, r.covariance) for r in prior.auto_covariances(df, ["well"], "k", ["a", "b", "c"], 6, "w").collect()}
    want = {}
    for x in rows:
        for y in rows:
            if x[0] == y[0] and 0 <= y[1] - x[1] <= 6:
                for p in range(3):
                    for q in range(3):
                        if x[2 + p] is not None and y[2 + q] is not None:
                            want.setdefault((y[1] - x[1], p, q), []).append((x[5] * y[5], x[5] * y[5] * x[2 + p] * y[2 + q]))
    assert got.keys() == want.keys()
    for k, v in want.items():
        n, weight, cov = len(v), sum(a for a, _ in v), sum(b for _, b in v)
        assert got[k] == pytest.approx((n, weight, cov / weight))
    lags, n = prior.lag_matrices(prior.auto_covariances(df, ["well"], "k", ["a", "b", "c"], 40, "w"), 3, 40)
    assert 20 < n <= 30 and (lags[n:] == 0).all() and np.allclose(lags[0], lags[0].T) and lags[1][0, 2] == got[1, 0, 2][2]


def test_centred_residuals(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 3.0, None)], "k int, a double, b double")
    assert [tuple(r) for r in prior.residuals(df, ["a", "b"]).orderBy("k").collect()] == [(1, -1.0, 0.0), (2, 1.0, None)]
    from pyspark.sql import functions as F

    assert [r.a for r in prior.residuals(df, ["a"], [F.col("k") * 1.0]).orderBy("k").collect()] == [0.0, 1.0]


def test_repair_to_positive_definite():
    rng = np.random.default_rng(3)
    lags = rng.normal(size=(9, 3, 3)) * np.exp(-np.arange(9) / 3)[:, None, None]
    lags[0] = lags[0] @ lags[0].T
    auto = prior.cyclic(lags, 24)
    big = np.block([[np.stack([np.roll(auto[p, q], s) for s in range(24)]) for q in range(3)] for p in range(3)])
    assert np.allclose(big, big.T) or np.allclose(auto[0, 1], np.roll(auto[1, 0][::-1], 1))
    assert np.linalg.eigvalsh((big + big.T) / 2).min() > 0
    assert np.allclose(np.diagonal(auto[:, :, 0]), np.diagonal(lags[0]))
    smooth = np.eye(3) * np.exp(-np.arange(9) ** 2 / 4.0)[:, None, None]
    assert np.allclose(prior.cyclic(smooth, 24, 10**9)[0, 0, :5], smooth[:5, 0, 0], atol=0.01)
    bad = np.diag([4.0, 1.0, 0.0])
    assert np.linalg.eigvalsh(prior.well_conditioned(bad)) == pytest.approx([0.0044, 1, 4]) and np.allclose(prior.well_conditioned(np.eye(3)), np.eye(3))
