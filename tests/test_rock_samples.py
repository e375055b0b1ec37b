import numpy as np
import pytest
from pyspark.sql import functions as F

from strataspark.functions import fluids
from strataspark.operators import rock_samples as R


def test_brine(spark):
    df = spark.createDataFrame([(20.0, 0.1, 0.0), (25.0, 0.1, 0.035), (25.0, 0.1, 0.264)], "t double, p double, s double")
    t, p, s = (F.col(c) for c in "tps")
    got = df.select(fluids.brine_density(t, p, s).alias("rho"), fluids.brine_velocity(t, p, s).alias("v"), fluids.brine_modulus(t, p, s).alias("k")).collect()
    # Water, and solutions of salt as measured at the surface: 3.5 % by weight, and saturated.
    assert got[0].rho == pytest.approx(0.998, abs=2e-3) and got[0].v == pytest.approx(1482, abs=3)
    assert got[1].rho == pytest.approx(1.0219, abs=2.5e-3) and got[1].v == pytest.approx(1535, abs=6)
    for r in got:
        assert r.k == pytest.approx(r.rho * r.v**2)
    assert got[2].rho == pytest.approx(1.198, abs=8e-3) and got[2].v == pytest.approx(1800, abs=20)


def test_copula(spark):
    r = [[1.0, 0.8, -0.3], [0.8, 1.0, 0.1], [-0.3, 0.1, 1.0]]
    u = [R.uniform(7, F.col("id"), F.lit(k)) for k in range(4)]
    df = spark.range(40000)
    z = df.select("id", *[c.alias(f"z{k}") for k, c in enumerate(R.correlated(R.normals(u)[:3], r))])
    a = z.orderBy("id").toPandas()[["z0", "z1", "z2"]].to_numpy()
    assert np.corrcoef(a.T) == pytest.approx(np.array(r), abs=0.02) and a.mean(axis=0) == pytest.approx(np.zeros(3), abs=0.02) and a.std(axis=0) == pytest.approx(np.ones(3), abs=0.02)
    flat = df.select(u[0].alias("u")).toPandas()["u"]
    assert 0 < flat.min() and flat.max() < 1 and np.histogram(flat, 10, (0, 1))[0] == pytest.approx(np.full(10, 4000), abs=300)
    again = df.repartition(13).select("id", *[c.alias(f"z{k}") for k, c in enumerate(R.correlated(R.normals(u)[:3], r))]).orderBy("id").toPandas()[["z0", "z1", "z2"]].to_numpy()
    assert (a == again).all()
    with pytest.raises(ValueError):
        R.correlated(u[:2], [[1.0, 0.5], [0.4, 1.0]])


def test_tables(spark):
    rng = np.random.default_rng(2)
    rows = [(k % 2, *map(float, np.exp(rng.normal(0, 0.2, 3)))) for k in range(60)]
    df = spark.createDataFrame(rows + [(2, 1.0, 0.0, 1.0), (2, 1.0, None, 1.0), (2, 1.0, 1.0, 1.0)], "node int, vp double, vs double, rho double").withColumn("n", F.lit("extra"))
    got = {r.node: r for r in R.rock_tables(df, ["node"]).collect()}
    for node in (0, 1):
        logs = np.log([r[1:] for r in rows if r[0] == node]).T
        assert (got[node].n, got[node].n_bad) == (30, 0)
        assert [got[node][f"mean_{c}"] for c in R.PARTS] == pytest.approx(logs.mean(axis=1))
        assert got[node].cov_vp_rho == pytest.approx(np.cov(logs)[0, 2]) and got[node].cov_vs_vs == pytest.approx(np.cov(logs)[1, 1])
    assert (got[2].n, got[2].n_bad, got[2].mean_vp, got[2].cov_vp_vp) == (3, 2, None, None)
    assert R.mean_table(R.rock_tables(df, ["node"]), ["node"]).first().mean_vp is None
    two = R.mean_table(R.rock_tables(df.where("node < 2"), ["node"]), ["node"]).first()
    assert two.n_nodes == 2 and two.mean_vp == pytest.approx((got[0].mean_vp + got[1].mean_vp) / 2)


def test_negative_variance(spark):
    got = spark.range(1).select(R.normal_with_trend(F.lit(1.0), F.lit(2.0), F.lit(-1.0)).alias("a"), R.normal_with_trend(F.lit(1.0), F.lit(2.0), F.lit(0.0)).alias("b")).first()
    assert (got.a, got.b) == (None, 2.0)


def test_error_covariance(spark):
    values = spark.createDataFrame([(10, 2.0), (10, 0.0), (10, None), (20, 3.0), (20, 5.0), (30, 0.0)], "angle int, v double")
    ratios = spark.createDataFrame([(10, 4.0), (20, 2.0), (30, 1.0), (40, 1.0)], "angle int, ratio double")
    scales = spark.createDataFrame([(10, 3.0), (10, 4.0)], "angle int, scale double")
    got = {(r.p, r.q): r.covariance for r in R.error_covariance(values, "angle", "v", ratios, lambda d: F.exp(-F.abs(d) / 10), scales).collect()}
    assert got == pytest.approx({(10, 10): 3.0, (20, 20): 8.5, (10, 20): np.sqrt(3 * 8.5) * np.exp(-1), (20, 10): np.sqrt(3 * 8.5) * np.exp(-1)})
    plain = R.error_covariance(values, "angle", "v", ratios, lambda d: F.exp(-F.abs(d) / 10)).where("p = 10 AND q = 10").first()
    assert plain.covariance == 1.0
