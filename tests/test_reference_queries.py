import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from strataspark.functions import elastic
from strataspark.operators import inversion, logs
from strataspark.plans import registry
from strataspark.streaming.timelapse import updated_state


@pytest.fixture(scope="module")
def oracle(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(x):
    if x is None or (isinstance(x, float) and np.isnan(x)) or x is pd.NaT:
        return None
    return round(float(x), 4) if isinstance(x, (float, np.floating)) else int(x) if isinstance(x, (int, np.integer)) else str(x)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, sf, oracle, name):
    got = registry.queries()[name](spark, sf)
    want = oracle.sql(registry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=key)
    other = sorted((tuple(plain(x) for x in r) for r in want.select(*[f'"{c}"' for c in columns]).fetchall()), key=key)
    assert len(rows) == len(other) > 0
    off = [(a, b) for a, b in zip(rows, other, strict=True) if a != b and not all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-4) for x, y in zip(a, b, strict=True))]
    assert not off, off[:3]


def test_synthetic_of_zero_values_is_that_of_sql(spark, tmp_path):
    """A logarithm of zero is -inf there, not null."""
    con = duckdb.connect()
    values = [1.0, 0.0, 2.0, None, 3.0, -1.0, 4.0, 0.0, 0.0, 5.0]
    pd.DataFrame({"event_id": range(10), "ts": pd.to_datetime("2024-01-01") + pd.to_timedelta(range(10), "h"), "user_id": [0] * 7 + [1] * 3, "value": values}).to_parquet(tmp_path / "events.parquet", coerce_timestamps="us")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = con.sql(registry.oracle_sql()["synthetic_seismic"]).fetchall()
    got = registry.queries()["synthetic_seismic"](spark, str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert any(np.isinf(r.synthetic) for r in got)


def test_synthetic_of_tied_times_does_not_depend_on_the_order_of_rows(spark, tmp_path):
    """Its SQL leaves ties open; by event_id they give one of its results, and the same one each time."""
    ids = np.arange(12)
    events = pd.DataFrame({"event_id": ids, "ts": pd.to_datetime("2024-01-01") + pd.to_timedelta(ids // 4, "h"), "user_id": 0, "value": 1.0 + ids * 5 % 12})
    sql, found = registry.oracle_sql()["synthetic_seismic"].replace("ORDER BY ts", "ORDER BY ts, event_id"), []
    for at, rows in enumerate((events, events[::-1], events.sample(frac=1, random_state=1))):
        (tmp_path / str(at)).mkdir()
        rows.to_parquet(tmp_path / str(at) / "events.parquet", coerce_timestamps="us")
        found.append(sorted(map(tuple, registry.queries()["synthetic_seismic"](spark, str(tmp_path / str(at))).collect())))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/0/events.parquet'")
    assert found == [sorted(con.sql(sql).fetchall())] * 3


def test_merge_is_anchored_at_the_start(spark):
    df = spark.createDataFrame([(1, float(z), v) for z, v in [(0, 1.0), (4, None), (8, 3.0), (12, 5.0), (30, 7.0)]] + [(2, 1.0, 2.0)], "well long, z double, v double")
    got = sorted((r.well, r.group, r.n, r.z) for r in logs.merge_near_duplicates(df, ["well"], "z", ["v"], 6.0).collect())
    assert got == [(1, 0, 2, 2.0), (1, 1, 2, 10.0), (1, 2, 1, 30.0), (2, 0, 1, 1.0)]


def test_kriging_keeps_data_and_trend(spark):
    data = spark.createDataFrame([(0, 1.0, 1.0, 5.0), (0, 1.0, 1.0, 7.0), (0, 4.0, 2.0, 1.0)], "layer int, x double, y double, value double")
    cells = spark.createDataFrame([(0, 1.0, 1.0), (0, 4.0, 2.0), (0, 900.0, 900.0), (1, 1.0, 1.0)], "layer int, x double, y double")
    got = {(r.layer, r.x): r.kriged for r in inversion.krige(data, cells, "layer", 3.0, trend=2.0).collect()}
    assert got == pytest.approx({(0, 1.0): 6.0, (0, 4.0): 1.0, (0, 900.0): 2.0, (1, 1.0): 2.0}, abs=1e-6)


def test_inversion_against_dense_solve(spark):
    rng = np.random.default_rng(1)
    g, a = rng.normal(size=(2, 3)), rng.normal(size=(3, 3))
    prior, noise, d, m = a @ a.T, 0.3 * np.eye(2), rng.normal(size=2), rng.normal(size=3)
    rows = spark.createDataFrame([(1, m.tolist(), d.tolist())], "id int, m array<double>, d array<double>")
    got = inversion.invert(rows, g, prior, noise, "m", "d").first()
    cov = np.linalg.inv(np.linalg.inv(prior) + g.T @ np.linalg.inv(noise) @ g)
    assert got.posterior == pytest.approx((cov @ (np.linalg.inv(prior) @ m + g.T @ np.linalg.inv(noise) @ d)).tolist())
    assert got.posterior_trace == pytest.approx(np.trace(cov))


def test_high_cut_keeps_low_frequencies(spark):
    t = np.arange(200)
    low, high = np.cos(2 * np.pi * 5 * (t + 0.5) * 0.004), np.cos(2 * np.pi * 60 * (t + 0.5) * 0.004)
    rows = spark.createDataFrame([((low + high).tolist(),)], "trace array<double>")
    assert np.allclose(logs.high_cut(rows, "trace", "cut", 4.0, 20.0).first().cut, low, atol=0.02)


def test_state_of_a_stream_is_that_of_a_batch(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_custkey % 10 AS cell", "o_totalprice / 1000 AS v", "50.0 + o_orderkey % 10 AS s").selectExpr("cell", "v", "double(s) AS s")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = updated_state(stream, ["cell"], "v", "s", 0.0, 100.0).writeStream.outputMode("complete").format("memory").queryName("state").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    want = {r.cell: (r.n, round(r.mean, 6)) for r in updated_state(rows, ["cell"], "v", "s", 0.0, 100.0).collect()}
    assert {r.cell: (r.n, round(r.mean, 6)) for r in spark.table("state").collect()} == want


def test_smooth_sizes():
    assert [elastic.smooth_size(n) for n in (1, 11, 13, 97, 120)] == [1, 12, 14, 98, 120]


def test_transform_against_numpy(spark):
    from strataspark.operators import traces

    cube = np.random.default_rng(3).normal(size=(3, 4, 5))
    cells = spark.createDataFrame([(*map(int, at), float(v), 0.0) for at, v in np.ndenumerate(cube) for at in [at]], "i long, j long, k long, re double, im double")
    turned = traces.transformed(cells, ("i", "j", "k"))
    want = np.fft.fftn(cube)
    assert all(abs(complex(r.re, r.im) - want[r.i, r.j, r.k]) < 1e-9 for r in turned.collect())
    assert all(abs(r.re - cube[r.i, r.j, r.k]) < 1e-9 for r in traces.transformed(turned, ("i", "j", "k"), inverse=True).collect())


def test_refined_traces_keep_their_samples(spark):
    from strataspark.operators import traces

    x = np.sin(np.arange(16) / 3) + np.arange(16)
    rows = spark.createDataFrame([(x.tolist(),), ([2.0],), ([],)], "v array<double>")
    got = [r.fine for r in traces.refined(rows, "v", "fine", 4).collect()]
    assert np.allclose(got[0][::4], x) and [len(g) for g in got] == [64, 4, 0]


def test_padding_of_small_axes(spark):
    """The series that an axis of 8 places has for 5, 4 and 3 cells."""
    from pyspark.sql import functions as F

    from strataspark.functions import padding

    rows = spark.range(9).select(*[padding.mirror_index(F.col("id"), F.lit(n), F.lit(8)).alias(f"n{n}") for n in (5, 4, 3)]).collect()
    assert [[r[c] for r in rows] for c in ("n5", "n4", "n3")] == [[0, 1, 2, 3, 4, 4, 1, 0, None], [0, 1, 2, 3, 3, 2, 1, 0, None], [0, 1, 2, 2, 1, 1, 1, 0, None]]


def test_chi_square_tail(spark):
    """Tabulated 5 % points, of even and odd degrees."""
    from strataspark.operators.wells import chi_square_tail

    points = {1: 3.841, 2: 5.991, 3: 7.815, 4: 9.488, 5: 11.070, 10: 18.307}
    rows = spark.createDataFrame([(float(f), x) for f, x in points.items()] + [(3.0, 0.0), (0.0, 1.0)], "f double, x double")
    got = [r.p for r in rows.select(chi_square_tail("x", "f").alias("p")).collect()]
    assert got[:6] == pytest.approx([0.05] * 6, abs=1e-4) and got[6] == 1 and (got[7] is None or np.isnan(got[7]))
