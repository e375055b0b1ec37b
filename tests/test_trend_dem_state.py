import numpy as np
import pytest
from pyspark.sql import functions as F

from strataspark.functions import inclusions
from strataspark.operators import trend
from strataspark.streaming import state4d as S


def plain_lines(at, mean, n, nz, least, low, high):
    """The regression by widening windows, one layer at a time."""
    by, out = dict(zip(at, zip(mean, n, strict=True), strict=True)), []
    for k in range(nz):
        need, r = least * (1 if min(at) <= k <= max(at) else 2), 0
        while True:
            used = [(j, *by[j]) for j in range(max(0, k - r), min(nz - 1, k + r) + 1) if j in by]
            if sum(c for *_, c in used) >= need or (k - r < 0 and k + r >= nz):
                break
            r += 1
        x, y, w = map(np.array, zip(*used, strict=True))
        out.append(y[0] if len(x) == 1 else np.polyval(np.polyfit(x, y, 1, w=np.sqrt(w)), k))
    return np.array(out)


def layers(spark, at, mean, n):
    return spark.createDataFrame([("a", int(k), float(m), int(c)) for k, m, c in zip(at, mean, n, strict=True)], "log string, k long, mean double, n long")


def test_local_lines(spark):
    rng = np.random.default_rng(1)
    at = np.sort(rng.choice(np.arange(5, 50), 25, replace=False))
    mean, n = 2000 + 10 * at + rng.normal(0, 30, 25), rng.integers(1, 6, 25)
    got = trend.local_lines(layers(spark, at, mean, n), ["log"], "k", 60, 15, 0, 1e9).orderBy("k").collect()
    assert [r.k for r in got] == list(range(60)) and {r.kind for r in got} == {"line"}
    assert [r.trend for r in got] == pytest.approx(plain_lines(at.tolist(), mean, n, 60, 15, 0, 1e9))
    few = trend.local_lines(layers(spark, at, mean, n), ["log"], "k", 60, 10**6, 0, 1e9).orderBy("k").collect()
    line = np.polyfit(at, mean, 1, w=np.sqrt(n))
    assert [r.trend for r in few] == pytest.approx(np.polyval(line, np.arange(60)))
    assert trend.least_data(3, 4.0) == 15 and trend.least_data(1, 1.0) == 50 and trend.least_data(1, 20.0) == 10


def test_lines_outside_the_limits(spark):
    at, mean, n = np.arange(10, 20), np.linspace(1000, 1900, 10), np.full(10, 5)
    ends = trend.local_lines(layers(spark, at, mean, n), ["log"], "k", 40, 10, 500, 2500).orderBy("k").collect()
    assert ends[0].kind == "first" and ends[0].trend == ends[10].trend and ends[39].kind == "last" and ends[39].trend == ends[19].trend and ends[15].kind == "line"
    all_ = trend.local_lines(layers(spark, at, mean, n), ["log"], "k", 40, 10, 500, 1500).collect()
    assert {r.kind for r in all_} == {"mean of all"} and [r.trend for r in all_] == pytest.approx([1450] * 40)
    one = trend.local_lines(layers(spark, [7], [3.0], [2]), ["log"], "k", 10, 10, 0, 9).collect()
    assert {(r.kind, r.trend) for r in one} == {("mean", 3.0)}
    assert trend.local_lines(layers(spark, [70], [3.0], [2]), ["log"], "k", 10, 10, 0, 9).count() == 0


def test_layer_means(spark):
    df = spark.createDataFrame([(1, 0, 2.0), (2, 0, 4.0), (1, 1, None)], "well int, k int, v double")
    assert [tuple(r) for r in trend.layer_means(df, [], "k", "v").collect()] == [(0, 3.0, 2)]


CASES = {"k": [37.0, 37.0, 20.0, 37.0, 10.0], "mu": [44.0, 44.0, 15.0, 44.0, 8.0], "ki": [2.2, 0.1, 2.5, 37.0, 5.0], "mui": [0.0, 0.0, 0.0, 44.0, 3.0], "aspect": [0.1, 0.5, 1.0, 0.2, 0.05], "part": [0.2, 0.3, 0.6, 0.4, 0.35]}


def fine(k, mu, ki, mui, aspect, part, steps=20000):
    """Classical Runge-Kutta by many small steps."""
    y, h = np.array([[k], [mu]]), part / steps
    args = [np.array([[v]]) for v in (ki, mui, aspect, 1.0)]
    f = lambda y, t: inclusions._slope(y, np.array([t]), *args)
    for s in range(steps):
        t = s * h
        a = f(y, t)
        b = f(y + h / 2 * a, t + h / 2)
        c = f(y + h / 2 * b, t + h / 2)
        y = y + h / 6 * (a + 2 * b + 2 * c + f(y + h * c, t + h))
    return y[:, 0]


def test_dem_against_fine_steps(spark):
    rows = spark.createDataFrame([tuple(map(float, r)) for r in zip(*CASES.values(), strict=True)], ", ".join(f"{c} double" for c in CASES)).withColumn("id", F.monotonically_increasing_id())
    got = rows.select("*", inclusions.dem(F.col("k"), F.col("mu"), [tuple(F.col(c) for c in ("ki", "mui", "aspect", "part"))]).alias("e")).collect()
    for r in got:
        assert (r.e.k, r.e.mu) == pytest.approx(fine(*[r[c] for c in CASES], steps=4000), rel=1e-5)
    assert (got[3].e.k, got[3].e.mu) == pytest.approx((37, 44))


def test_dem_of_several_inclusions_and_odd_rows(spark):
    one = lambda *v: tuple(F.lit(float(x)) for x in v)
    base = spark.range(1)
    get = lambda k, mu, *inc: base.select(inclusions.dem(F.lit(k).cast("double"), F.lit(mu).cast("double"), list(inc)).alias("e")).first().e
    halves, whole = get(37.0, 44.0, one(2.2, 0, 0.1, 0.1), one(2.2, 0, 0.1, 0.1)), get(37.0, 44.0, one(2.2, 0, 0.1, 0.2))
    assert (halves.k, halves.mu) == pytest.approx((whole.k, whole.mu), rel=1e-6)
    assert tuple(get(37.0, 44.0, one(2.2, 1.0, 0.1, 1.0))) == (2.2, 1.0) and tuple(get(37.0, 44.0, one(2.2, 0, 0.1, 0))) == (37, 44)
    assert get(37.0, 44.0, one(2.2, 0, 2.0, 0.1)) is None and get(37.0, 44.0, one(2.2, 0, 0.1, 1.5)) is None and get(None, 44.0, one(2.2, 0, 0.1, 0.5)) is None
    stays = get(37.0, 44.0, one(30.0, 20.0, 0.3, 0.5), one(20.0, 10.0, 0.6, 0.5))
    assert 20 < stays.k < 30 and 10 < stays.mu < 20


def setting():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(6, 6))
    cov = a @ a.T / 3 + 0.1 * np.eye(6)
    return S.Prior(rng.normal(size=6), cov, 2000.0), S.Evolution(np.array([0.9, 0.7, 1.0]), np.array([0.1, 0.0, -0.2]), np.diag([0.05, 0.1, 0.02]))


def test_steps_add_up_and_split_inverts_merge():
    prior, ev = setting()
    two = S.evolved(*S.evolved(prior.mean, prior.cov, ev, 1.3), ev, 0.9)
    for x, y in zip(two, S.evolved(prior.mean, prior.cov, ev, 2.2), strict=True):
        assert np.allclose(x, y)
    d, r = np.array([1.0, -1, 2]), np.diag([0.3, 0.2, 0.5])
    want = S.observed(prior.mean, prior.cov, S.SUM, d, r)
    now = S.merged(prior.mean, prior.cov)
    gain = now[1] @ np.linalg.inv(now[1] + r)
    got = S.split(prior.mean, prior.cov, now[0] + gain @ (d - now[0]), now[1] - gain @ now[1])
    assert np.allclose(got[0], want[0]) and np.allclose(got[1], want[1])
    assert np.allclose(S.merged(*got)[0], now[0] + gain @ (d - now[0])) and np.allclose(S.split(prior.mean, prior.cov, *now)[1], prior.cov)


def vintages(n=6, seed=3):
    rng, rows = np.random.default_rng(seed), []
    for cell in range(5):
        for _ in range(n):
            d = [None if rng.random() < 0.2 else float(v) for v in rng.normal(size=3)]
            rows.append((cell, float(rng.choice([1999.5, 2001.0, 2003.5, 2007.25, 2010.0])), d, [0.5, 0.4, 0.3]))
    return rows


SCHEMA = "cell int, time double, data array<double>, variance array<double>"


def test_states_against_one_dense_problem(spark):
    """All vintages at once: the joint Gaussian of the states at all times."""
    prior, ev = setting()
    rows = vintages()
    got = {r.cell: r for r in S.states(spark.createDataFrame(rows, SCHEMA), ["cell"], prior, ev).collect()}
    for cell in range(5):
        own = [(max(t, 2000.0), np.array([np.nan if v is None else v for v in d], float), np.array(e)) for c, t, d, e in rows if c == cell]
        last = max(t for t, *_ in own)
        mean = lambda t: ev.over(t - 2000)[0] @ prior.mean + ev.over(t - 2000)[1]
        at = lambda t: ev.over(t - 2000)[0] @ prior.cov @ ev.over(t - 2000)[0].T + ev.over(t - 2000)[2]

        def between(t, u):
            return at(t) @ ev.over(u - t)[0].T if u >= t else ev.over(t - u)[0] @ at(u)

        picks = [(t, S.SUM[k], d[k], e[k]) for t, d, e in own for k in range(3) if not np.isnan(d[k])]
        cov = np.array([[p @ between(t, u) @ q for u, q, *_ in picks] for t, p, *_ in picks]) + np.diag([e for *_, e in picks])
        side = np.array([between(last, t) @ p for t, p, *_ in picks]).T
        gap = np.array([v - p @ mean(t) for t, p, v, _ in picks])
        assert got[cell].n == 6 and got[cell].time == last
        assert got[cell].mean == pytest.approx(mean(last) + side @ np.linalg.solve(cov, gap))
        assert got[cell].covariance == pytest.approx((at(last) - side @ np.linalg.solve(cov, side.T)).ravel(), abs=1e-9)


def test_late_and_reordered_vintages_of_a_stream_give_the_batch_result(spark, tmp_path):
    prior, ev = setting()
    rows = vintages()
    order = np.random.default_rng(4).permutation(len(rows))
    for k, part in enumerate(np.array_split(order, 3)):
        spark.createDataFrame([rows[i] for i in part], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"{k}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    found: dict = {}
    keep = lambda df, _: found.update({r.cell: r for r in df.collect()})
    query = S.streamed_states(stream, ["cell"], prior, ev).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    for r in S.states(spark.createDataFrame(rows, SCHEMA), ["cell"], prior, ev).collect():
        assert found[r.cell].n == r.n and found[r.cell].mean == pytest.approx(r.mean) and found[r.cell].covariance == pytest.approx(r.covariance)


def test_vintages_without_time_or_data(spark):
    prior, ev = setting()
    df = spark.createDataFrame([(1, None, [1.0, 1.0, 1.0], [1.0] * 3), (1, 2000.0, [None, None, None], [1.0] * 3)], SCHEMA)
    r = S.states(df, ["cell"], prior, ev).first()
    assert r.n == 1 and r.mean == pytest.approx(prior.mean)


def test_cells_are_filtered_together():
    """The same state as one cell's after the other, whatever the numbers of vintages; without a fold for each cell."""
    prior, ev = setting()
    rng = np.random.default_rng(5)
    counts = np.array([0, 3, 1, 12, 0, 5, 3])
    n = int(counts.sum())
    time, data, variance = rng.choice([1998.0, 2000.0, 2001.5, 2004.0], n), rng.normal(size=(n, 3)), rng.uniform(0.1, 1, (n, 3))
    data[rng.random((n, 3)) < 0.3], variance[rng.random((n, 3)) < 0.1] = np.nan, 0.0
    mean, cov, now = S.filtered_together(counts, time, data, variance, prior, ev)
    cells = np.repeat(np.arange(len(counts)), counts)
    for k in range(len(counts)):
        want = S.filtered([(time[v], data[v], variance[v]) for v in np.flatnonzero(cells == k)], prior, ev)
        assert now[k] == want[2] and np.allclose(mean[k], want[0], atol=1e-12) and np.allclose(cov[k], want[1], atol=1e-12)


def test_vintage_of_null_data(spark):
    """A vintage whose data are null is one, as any that wasn't observed; it does not shift the others'."""
    prior, ev = setting()
    df = spark.createDataFrame([(1, 2001.0, [1.0, 2.0, 3.0], [0.5] * 3), (1, 2002.0, None, [0.5] * 3), (1, 2003.0, [0.0, None, 1.0], [0.5] * 3)], SCHEMA)
    r = S.states(df, ["cell"], prior, ev).first()
    want = S.filtered([(2001.0, np.array([1.0, 2, 3]), np.full(3, 0.5)), (2003.0, np.array([0, np.nan, 1]), np.full(3, 0.5))], prior, ev)
    assert (r.n, r.time) == (3, 2003.0) and r.mean == pytest.approx(want[0]) and r.covariance == pytest.approx(want[1].ravel())
