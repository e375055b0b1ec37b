import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataspark.operators import cokriging, density, logs, wells

COV = np.array([[1.0, 0.6, -0.2], [0.6, 0.8, 0.1], [-0.2, 0.1, 0.5]])


def correlation(dx, dy, dz):
    return np.exp(-3 * np.sqrt((dx / 20) ** 2 + (dy / 15) ** 2 + (dz / 8) ** 2))


def points(n, seed=1):
    rng = np.random.default_rng(seed)
    at, v = rng.uniform(0, 30, (n, 3)).round(2), rng.normal(size=(n, 3))
    v[rng.random((n, 3)) < 0.25] = np.nan
    return at, v


def frame(spark, at, v):
    rows = [(0, *map(float, p), *[None if np.isnan(x) else float(x) for x in q]) for p, q in zip(at, v, strict=True)]
    return spark.createDataFrame(rows, "layer int, x double, y double, z double, a double, b double, c double").repartition(3)


def dense(at, v, target):
    """Co-kriging of each value by one solve over all data, from the definition."""
    out = []
    for g in range(3):
        use = [(i, p) for i in range(len(at)) for p in range(3) if not np.isnan(v[i, p]) and (p == g or np.isnan(v[i, g]))]
        k = np.array([[COV[p, q] * correlation(*(at[i] - at[j])) for j, q in use] for i, p in use])
        near = np.array([COV[g, p] * correlation(*(target - at[i])) for i, p in use])
        out.append(near @ np.linalg.solve(k, np.array([v[i, p] for i, p in use])))
    return out


def krige(data, targets, **kw):
    arguments = {"block": [7.0, 9.0, 11.0], "reach": [100.0, 100.0, 100.0], "limit": 1000} | kw
    return cokriging.krige_blocks(data, targets, ["layer"], ["x", "y", "z"], ["a", "b", "c"], COV, correlation, **arguments)


def test_blocks_whose_halo_holds_all_data_equal_the_dense_solve(spark):
    at, v = points(40)
    goal = np.random.default_rng(2).uniform(-5, 35, (60, 3)).round(2)
    targets = spark.createDataFrame([(0, k, *map(float, p)) for k, p in enumerate(goal)], "layer int, id int, x double, y double, z double")
    got = krige(frame(spark, at, v), targets).collect()
    assert len(got) == 60
    for r in got:
        assert (r.a_kriged, r.b_kriged, r.c_kriged) == pytest.approx(dense(at, v, goal[r.id]), abs=1e-8)


def test_halo_limit_and_rows_without_data(spark):
    at, v = points(30)
    v[:] = np.where(np.isnan(v), 0.5, v)
    data = frame(spark, at, v)
    centre = np.array([3.5, 4.5, 5.5])
    targets = spark.createDataFrame([(0, 0, *centre.tolist()), (0, 1, 900.0, 900.0, 900.0), (1, 2, 3.5, 4.5, 5.5), (0, 3, None, 1.0, 1.0)], "layer int, id int, x double, y double, z double")
    got = {r.id: (r.a_kriged, r.b_kriged, r.c_kriged) for r in krige(data, targets, limit=5, reach=[20.0, 20.0, 20.0]).collect()}
    box = np.array([7.0, 9.0, 11.0])
    far = (np.maximum(0, np.maximum(-at, at - box)) / 20) ** 2
    order = sorted(range(30), key=lambda i: (far[i].sum(), *at[i]))
    near = [i for i in order if (np.maximum(0, np.maximum(-at[i], at[i] - box)) <= 20).all()][:5]
    assert got[0] == pytest.approx(dense(at[near], v[near], centre), abs=1e-8)
    assert got[1] == (0, 0, 0) and got[2] == (0, 0, 0) and got[3] == (None, None, None)


def test_data_at_one_place_are_averaged_and_exact(spark):
    rows = [(0, 1.0, 1.0, 1.0, 2.0, None, None), (0, 1.0, 1.0, 1.0, 4.0, None, None), (0, 9.0, 9.0, 9.0, 1.0, 5.0, None), (0, None, 1.0, 1.0, 99.0, 1.0, 1.0)]
    data = spark.createDataFrame(rows, "layer int, x double, y double, z double, a double, b double, c double")
    got = krige(data, data.select("layer", "x", "y", "z").distinct().where("x IS NOT NULL")).orderBy("x").collect()
    assert [r.a_kriged for r in got] == pytest.approx([3.0, 1.0], abs=1e-6) and got[1].b_kriged == pytest.approx(5.0, abs=1e-6)


def test_a_matrix_that_is_not_positive_definite():
    a = np.ones((3, 3))
    assert a @ cokriging._positive_solve(a, np.ones(3)) == pytest.approx(np.ones(3), abs=1e-6)


def samples(spark, n=400):
    rng = np.random.default_rng(3)
    f = rng.integers(0, 2, n)
    x = rng.normal(size=(n, 3)) @ np.diag([0.3, 0.2, 0.1]) + f[:, None] * [0.8, -0.3, 0.2]
    rows = [(int(a), *map(float, v)) for a, v in zip(f, x, strict=True)] + [(None, 0.0, 0.0, 0.0), (1, None, 0.0, 0.0)]
    return spark.createDataFrame(rows, "facies int, vp double, vs double, rho double").repartition(3), f, x


VALUES = ["vp", "vs", "rho"]


def test_smoothed_densities_against_a_direct_sum(spark):
    df, f, x = samples(spark)
    noise = np.array([[0.02, 0.01, 0], [0.01, 0.03, 0], [0, 0, 1e-9]])
    box = density.volume(df, "facies", VALUES, noise, bins=(12, 10, 8))
    width = (4 / 7) ** (1 / 7) * 400 ** (-1 / 7)
    assert np.diag(box.smoothing) == pytest.approx(np.maximum(np.diag(noise), width**2 * x.var(axis=0, ddof=1)))
    found = density.densities(df, "facies", VALUES, box)
    kernel, n = np.linalg.inv(box.smoothing), np.array(box.bins)
    place = np.minimum(np.floor((x - box.low) / box.step).astype(int), n - 1)
    every = np.stack(np.meshgrid(*map(np.arange, box.bins), indexing="ij"), axis=-1).reshape(-1, 3)
    lag = lambda d: np.where(d % n <= n // 2, d % n, d % n - n) * box.step
    weight = lambda d: np.exp(-0.5 * np.einsum("...i,ij,...j", lag(d), kernel, lag(d)))
    total = weight(every).sum()
    for k in (0, 1):
        direct = sum(weight(every - p) for p in place[f == k]) / total / (f == k).sum()
        assert found[k].ravel() == pytest.approx(direct, abs=1e-7) and found[k].sum() == pytest.approx(1, abs=1e-4)


def test_cell_probabilities(spark):
    df, f, x = samples(spark)
    box = density.volume(df, "facies", VALUES, bins=(20, 20, 20))
    found = density.densities(df, "facies", VALUES, box)
    prior = {0: 0.3, 1: 0.7}
    cells = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate([[0, 0, 0], [0.8, -0.3, 0.2], [99, 99, 99]])] + [(3, None, 0.0, 0.0)], "id int, vp double, vs double, rho double")
    got = {r.id: r for r in density.probabilities(cells, VALUES, found, box, prior).collect()}
    for k in (0, 1, 2):
        assert got[k].p_0 + got[k].p_1 + got[k].p_undefined == pytest.approx(1)
    assert got[0].p_0 > 0.9 and got[1].p_1 > 0.9 and got[2].p_undefined > 0.5 and got[3].p_0 is None
    at = box.low + (np.array([4, 5, 6]) + 0.5) * box.step
    assert density.interpolated(found[0], box, np.array([at, at + box.step * [0.5, 0, 0]])) == pytest.approx([found[0][4, 5, 6], (found[0][4, 5, 6] + found[0][5, 5, 6]) / 2])
    with pytest.raises(ValueError, match="two samples"):
        density.volume(df.where("false"), "facies", VALUES)


def test_directions_of_most_information():
    rng = np.random.default_rng(4)
    a = rng.normal(size=(3, 3))
    prior = a @ a.T + np.eye(3)
    g = rng.normal(size=(2, 3))
    post = np.linalg.inv(np.linalg.inv(prior) + g.T @ g)
    v = density.directions(prior, post)
    values = [(w @ post @ w) / (w @ prior @ w) for w in v]
    every = np.sort(np.linalg.eigvals(np.linalg.solve(prior, post)).real)
    assert values == pytest.approx(every[:2]) and every[2] == pytest.approx(1) and np.linalg.norm(v, axis=1) == pytest.approx([1, 1])


def test_merging_over_bins(spark, monkeypatch):
    """Pieces that end in one bin and begin in another, against the plain fold."""
    rng = np.random.default_rng(5)
    rows = [(w, float(z), float(rng.normal()) if rng.random() < 0.8 else None) for w in range(4) for z in np.cumsum(rng.choice([0.2, 0.4, 0.6, 3.0, 25.0], 300)).round(1)] + [(9, None, 1.0), (8, 5.0, None)]
    df = spark.createDataFrame(rows, "well int, z double, v double")
    want = {}
    for w in range(4):
        start, g = None, -1
        for _, z, v in sorted((r for r in rows if r[0] == w), key=lambda r: r[1]):
            if start is None or z >= start + 1.0:
                start, g = z, g + 1
            want.setdefault((w, g), []).append((z, v))
    for width, folded in ((0.5, 100), (3.0, 400), (1000.0, 20_000)):
        monkeypatch.setattr(logs, "FOLDED", folded)
        got = {(r.well, r.group): r for r in logs.merge_near_duplicates(df, ["well"], "z", ["v"], 1.0, width).collect()}
        assert got.keys() == want.keys() | {(8, 0)} and got[8, 0].v is None
        for k, x in want.items():
            known = [v for _, v in x if v is not None]
            assert (got[k].n, got[k].z) == (len(x), pytest.approx(np.mean([z for z, _ in x]))) and (got[k].v == pytest.approx(np.mean(known)) if known else got[k].v is None)


def test_chi_square_tails(spark):
    import pandas as pd

    def series(x, freedom):
        """Sums of the closed form for whole degrees of freedom."""
        odd, half = freedom % 2, x / 2
        return math.fsum([math.erfc(math.sqrt(half)) if odd else 0.0, *(math.exp(s * math.log(half) - half - math.lgamma(s + 1)) for s in (i + odd / 2 for i in range((freedom - odd) // 2)))])

    cases = [(x, k) for k in (1, 2, 3, 10, 101, 5000) for x in (1e-6, 0.3, 1.0, k * 0.5, k * 1.0, k * 1.3, k * 3.0 + 20)]
    got = wells.upper_gamma(np.array([k / 2 for _, k in cases]), np.array([x / 2 for x, _ in cases]))
    assert got == pytest.approx([series(x, k) for x, k in cases], rel=1e-9, abs=1e-14)
    odd = spark.createDataFrame([(0.0, 3.0), (-1.0, 3.0), (1.0, None), (None, 2.0), (1.0, 0.5)], "x double, f double").select(wells.chi_square_tail("x", "f").alias("p")).toPandas()["p"]
    assert odd.iloc[:2].tolist() == [1, 1] and pd.isna(odd.iloc[2:]).all()
