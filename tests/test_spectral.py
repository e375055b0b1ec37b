import numpy as np
import pytest

from strataspark.operators import spectral as S

NX, NY, NZ, ANGLES = 4, 3, 8, 2


def correlation(i, j):
    return np.exp(-1.5 * np.hypot(i, 0.7 * j))


def lag_covariance(n, cov, range_):
    k = np.arange(n)
    return cov[:, :, None] * np.exp(-(np.minimum(k, n - k) / range_))


def model(**kw):
    rng = np.random.default_rng(4)
    a = rng.normal(size=(3, 3))
    wavelets = np.zeros((ANGLES, NZ))
    wavelets[:, [0, 1, -1, 2]] = [[1, -0.3, -0.4, 0.1], [0.8, -0.2, -0.35, 0]]
    e = rng.normal(size=(ANGLES, ANGLES))
    return S.Model(rng.normal(size=(ANGLES, 3)), wavelets, lag_covariance(NZ, a @ a.T, 1.7), 0.2 * (e @ e.T + np.eye(ANGLES)), 0.3, low=-1, **kw)


def circulant(row):
    return np.stack([np.roll(row, s) for s in range(len(row))], axis=1)


def dense(m, d, prior, lateral):
    """Posterior mean, covariance and residual by matrices over all cells, written out in real space: cells in order i, j, k."""
    n = NX * NY
    i, j = (v.ravel() for v in np.mgrid[:NX, :NY])
    wrap = lambda v, size: np.where(v % size < size - v % size, v % size, v % size - size)
    far = correlation(wrap(i[:, None] - i, NX), wrap(j[:, None] - j, NY)) if lateral else np.eye(n)
    w = [circulant(x) for x in m.wavelets]
    shift = circulant(np.eye(NZ)[1])
    forward, backward = np.linalg.inv(shift) - np.eye(NZ), np.eye(NZ) - shift
    third = [(np.linalg.inv(shift) - shift) / 2 @ backward @ forward @ x for x in w]
    norm = lambda x: x / np.sqrt((x[:, 0] ** 2).sum())
    blocks = lambda f, rows, cols: np.block([[f(p, q) for q in range(cols)] for p in range(rows)])
    big = lambda x, f=np.eye(n): np.kron(f, x)
    g = blocks(lambda p, q: big(m.reflection[p, q] * w[p] @ forward), ANGLES, 3)
    cov = blocks(lambda p, q: big(circulant(m.auto[p, q]), far), 3, 3)
    err = blocks(lambda p, q: big(0.5 * (1 - m.white) * m.noise[p, q] * sum(norm(x[p]) @ norm(x[q]).T for x in (w, third)), far) + big(m.white * m.noise[p, q] * np.eye(NZ)) * (p == q), ANGLES, ANGLES)
    gain = cov @ g.T @ np.linalg.inv(g @ cov @ g.T + err)
    mean = prior + gain @ (d - g @ prior)
    return mean, cov - gain @ g @ cov, d - g @ mean


def traces(spark, d, prior):
    """Rows (i, j, data, prior) of vectors in order channel, i, j, k."""
    a, b = d.reshape(-1, NX, NY, NZ), prior.reshape(3, NX, NY, NZ)
    rows = [(i, j, a[:, i, j].ravel().tolist(), b[:, i, j].ravel().tolist()) for i in range(NX) for j in range(NY)]
    return spark.createDataFrame(rows, "i int, j int, data array<double>, prior array<double>").repartition(3)


def vectors(found, column):
    out = {(r.i, r.j): np.array(r[column]).reshape(-1, NZ) for r in found}
    return np.stack([[out[i, j] for j in range(NY)] for i in range(NX)]).transpose(2, 0, 1, 3).reshape(-1)


@pytest.fixture(params=[1, 8 << 20], ids=["small blocks", "one block"])
def blocks(request, monkeypatch):
    monkeypatch.setattr(S, "GROUP", request.param)


@pytest.mark.parametrize("lateral", [True, False])
def test_posterior_against_a_dense_solve(spark, blocks, lateral):
    rng, m = np.random.default_rng(1), model()
    d, prior = rng.normal(size=ANGLES * NX * NY * NZ), rng.normal(size=3 * NX * NY * NZ)
    shape = S.Shape(NX, NY, NZ, ANGLES + 4)
    found, cov = S.inverted(traces(spark, d, prior), NX, NY, shape, m, correlation if lateral else lambda i, j: ((i == 0) & (j == 0)).astype(float))
    found = found.collect()
    mean, left, residual = dense(m, d, prior, lateral)
    assert vectors(found, "mean") == pytest.approx(mean, abs=1e-8)
    assert vectors(found, "residual") == pytest.approx(residual, abs=1e-8)
    lags = S.covariances(cov, shape)
    n = NX * NY * NZ
    for p in range(3):
        for q in range(3):
            assert lags[p, q] == pytest.approx(left[p * n : p * n + NZ, q * n], abs=1e-9)


def test_frequencies_that_are_not_inverted_keep_the_prior(spark):
    rng, m = np.random.default_rng(2), model(high=2)
    d, prior = rng.normal(size=ANGLES * NX * NY * NZ), rng.normal(size=3 * NX * NY * NZ)
    found, _ = S.inverted(traces(spark, d, prior), NX, NY, S.Shape(NX, NY, NZ, ANGLES + 4), m, correlation)
    change = np.fft.rfft((vectors(found.collect(), "mean") - prior).reshape(3, NX, NY, NZ), axis=3)
    assert np.abs(change[..., 2:]).max() < 1e-9 < np.abs(change[..., :2]).max()


def test_dipping_layers(spark):
    """The lateral field of a slope is that of level layers, moved down cell by cell."""
    shape = S.Shape(6, 5, 8, 1)
    i, j = (v.ravel() for v in np.mgrid[:6, :5])
    level, dip = S.lateral_impulse(i, j, shape, correlation), S.lateral_impulse(i, j, shape, correlation, (1.0, -2.0))
    for r in range(len(i)):
        at = -((i[r] if i[r] < 3 else i[r] - 6) * 1 + (j[r] if j[r] < 3 else j[r] - 5) * -2)
        assert np.array_equal(dip[r], np.roll(level[r], at))
    half = S.lateral_impulse(np.array([1]), np.array([0]), shape, correlation, (0.25, 0.0))[0]
    assert half[7] == pytest.approx(0.25 * correlation(1, 0)) and half[0] == pytest.approx(0.75 * correlation(1, 0))


def test_transform_there_and_back_with_padding(spark, blocks):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(4, 3, 16))
    rows = spark.createDataFrame([(i, j, v[i, j].tolist()) for i in range(4) for j in range(3)], "i int, j int, v array<double>")
    shape = S.Shape(6, 5, 8, 2)
    whole = S.padded(rows, 4, 3, shape)
    cube = {(r.i, r.j): r.v for r in whole.collect()}
    assert len(cube) == 30 and cube[4, 0] == v[1, 0].tolist() and cube[5, 4] == v[0, 0].tolist()
    back = {(r.i, r.j): r.v for r in S.to_traces(S.to_frequencies(whole, shape), shape).collect()}
    assert back.keys() == cube.keys() and all(back[k] == pytest.approx(cube[k]) for k in cube)
    with pytest.raises(Exception, match="one trace at each place"):
        S.to_frequencies(whole.where("NOT (i = 1 AND j = 1)"), shape).collect()


def test_simulations_have_the_posterior_mean_and_covariance(spark):
    """1,000 draws of a small cube against the dense posterior."""
    rng, m, n = np.random.default_rng(5), model(), 250
    d, prior = rng.normal(size=ANGLES * NX * NY * NZ), rng.normal(size=3 * NX * NY * NZ)
    mean, cov, _ = dense(m, d, prior, True)
    drawn = []
    for seed in range(4):
        shape = S.Shape(NX, NY, NZ, ANGLES + 4 + 3 * n)
        found, _ = S.inverted(traces(spark, d, prior), NX, NY, shape, m, correlation, simulations=n, seed=seed)
        out = {(r.i, r.j): np.array(r.simulated).reshape(n, 3, NZ) for r in found.collect()}
        drawn.append(np.stack([[out[i, j] for j in range(NY)] for i in range(NX)]).transpose(2, 3, 0, 1, 4).reshape(n, -1))
    drawn = np.concatenate(drawn)
    spread = np.sqrt(np.diag(cov))
    assert (np.abs(drawn.mean(axis=0) - mean) < 5 * spread / np.sqrt(1000) + 1e-6).all()
    seen = np.cov(drawn.T)
    assert (np.abs(seen - cov) < 6 * np.sqrt((np.outer(spread, spread) ** 2 + cov**2) / 1000) + 1e-6).all()


def test_draws_do_not_depend_on_partitions(spark):
    rng, m = np.random.default_rng(6), model()
    d, prior = rng.normal(size=ANGLES * NX * NY * NZ), rng.normal(size=3 * NX * NY * NZ)
    shape, seen = S.Shape(NX, NY, NZ, ANGLES + 4 + 6), []
    for parts, seed in ((1, 3), (7, 3), (7, 4)):
        found, _ = S.inverted(traces(spark, d, prior).repartition(parts), NX, NY, shape, m, correlation, simulations=2, seed=seed)
        seen.append(vectors(found.collect(), "simulated"))
    assert np.allclose(seen[0], seen[1], atol=1e-10) and not np.allclose(seen[1], seen[2], atol=0.1)
