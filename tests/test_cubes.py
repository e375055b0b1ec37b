import math
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataspark.operators import lateral
from strataspark.sources import grids, ranges, segy


def survey(spark, n_il=7, n_xl=9, turn=25.0, hole=(), amps=12, first=(100, 500), step=(2, 3), skew=0.0):
    """Traces of a turned survey; amplitudes tell the lines."""
    a, rows, t = math.radians(turn), [], 0
    for p in range(n_il):
        for q in range(n_xl):
            if (p, q) in hole:
                continue
            x, y = 1000 + 50 * p * math.cos(a) - 30 * q * math.sin(a + skew), 2000 + 50 * p * math.sin(a) + 30 * q * math.cos(a + skew)
            rows.append((t, first[0] + step[0] * p, first[1] + step[1] * q, round(x, 2), round(y, 2), [float(p * 100 + q + k / 8) for k in range(amps - q % 2)]))
            t += 1
    return spark.createDataFrame(rows, "trace int, il int, xl int, x double, y double, amp array<float>")


@pytest.mark.parametrize("kind", [1, 5])
def test_segy_round_trip_over_splits(spark, tmp_path, kind):
    path, traces = str(tmp_path / "a.sgy"), survey(spark, hole={(3, 3)})
    ranges.shared_folder(spark)
    segy.write_segy(traces.repartition(5), path, 100.0, 4.0, 12, kind=kind)
    assert os.listdir(tmp_path) == ["a.sgy"] and os.path.getsize(path) == 3600 + 62 * (240 + 48)
    got = segy.read_segy(spark, path, split=288 * 4)
    assert got.rdd.getNumPartitions() == 16
    want = {(r.il, r.xl): r for r in traces.collect()}
    rows = got.collect()
    assert len(rows) == 62 and [r.trace for r in rows] == list(range(62)) and all((a.il, a.xl) < (b.il, b.xl) for a, b in zip(rows, rows[1:]))
    for r in rows:
        w = want[r.il, r.xl]
        assert (r.x, r.y, r.z0, r.dz) == pytest.approx((w.x, w.y, 100, 4)) and r.amp == w.amp + [0.0] * (12 - len(w.amp))


def test_segy_reads_only_the_lines_asked_for(spark, tmp_path):
    path = str(tmp_path / "a.sgy")
    ranges.shared_folder(spark)
    segy.write_segy(survey(spark), path, 0.0, 4.0, 12)
    got = segy.read_segy(spark, path).where("il >= 104 AND il < 110 AND xl IN (500, 506) AND x > 0")
    assert sorted((r.il, r.xl) for r in got.collect()) == [(i, x) for i in (104, 106, 108) for x in (500, 506)]
    reader = segy.SegyReader({"path": path})
    left = list(reader.pushFilters([segy.GreaterThan(("il",), 108), segy.EqualTo(("x",), 1.0)]))
    assert left == [segy.EqualTo(("x",), 1.0)]
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert {x for b in batches for x in b.column("il").to_pylist()} == {110, 112}


def test_segy_by_hand(spark, tmp_path):
    """A file built byte by byte: 16-bit samples, a further text header, coordinates scaled by 10, other places of lines."""
    head = bytearray(3600 + 3200)
    struct.pack_into(">h", head, 3216, 2000), struct.pack_into(">h", head, 3220, 3), struct.pack_into(">h", head, 3224, 3), struct.pack_into(">h", head, 3504, 1)
    body = b""
    for t in range(2):
        h = bytearray(240)
        struct.pack_into(">i", h, 188, 7), struct.pack_into(">i", h, 192, 40 + t), struct.pack_into(">i", h, 180, 5), struct.pack_into(">i", h, 184, 6)
        struct.pack_into(">h", h, 70, 10), struct.pack_into(">h", h, 108, -20)
        body += bytes(h) + struct.pack(">3h", t, -5, 300)
    (tmp_path / "b.sgy").write_bytes(bytes(head) + body)
    got = [tuple(r)[1:] for r in segy.read_segy(spark, str(tmp_path / "*.sgy"), header="SIP").collect()]
    assert got == [(0, 7, 40, 50, 60, -20, 2, [0, -5, 300]), (1, 7, 41, 50, 60, -20, 2, [1, -5, 300])]
    assert segy.read_segy(spark, str(tmp_path / "b.sgy"), header="sip", bypass_coordinate_scaling="yes", location_il=193).select("il", "x").first() == (40, 5)
    (tmp_path / "c.sgy").write_bytes(bytes(head) + body[:-1])
    with pytest.raises(Exception, match="cut short"):
        segy.read_segy(spark, str(tmp_path / "c.sgy")).collect()


def test_ibm_floats():
    known = {0x42640000: 100.0, 0xC276A000: -118.625, 0x00000000: 0.0, 0x40800000: 0.5, 0x41100000: 1.0}
    assert segy.ibm_to_float(np.array(list(known))).tolist() == list(known.values())
    assert segy.float_to_ibm(np.array(list(known.values()))).tolist() == list(known)
    x = np.random.default_rng(1).normal(size=20000) * 10.0 ** np.random.default_rng(2).integers(-20, 20, 20000)
    back = segy.ibm_to_float(segy.float_to_ibm(x))
    assert (np.abs(back / x - 1) < 1e-6).all()


def test_two_traces_of_one_place_leave_no_file(spark, tmp_path):
    traces = survey(spark)
    ranges.shared_folder(spark)
    with pytest.raises(ValueError, match="one place"):
        segy.write_segy(traces.union(traces.limit(1)), str(tmp_path / "a.sgy"), 0.0, 4.0, 12)
    assert os.listdir(tmp_path) == []


@pytest.mark.parametrize("turn", [0, 25, -30, 80, 130, 200, -100])
@pytest.mark.parametrize("mirror", [False, True])
def test_geometry_of_turned_surveys(spark, turn, mirror):
    traces = survey(spark, turn=turn, hole={(0, 1), (3, 3)})
    if mirror:
        traces = traces.selectExpr("trace", "xl AS il", "il AS xl", "x", "y")
    g = lateral.fitted(traces)
    assert abs(math.degrees(g.angle)) <= 45.001 and {g.nx, g.ny} == {7, 9} and sorted([g.dx, g.dy]) == pytest.approx([30, 50], abs=0.01)
    i, j = g.cell(F.col("il"), F.col("xl"))
    ci, cj = g.cell_at(F.col("x"), F.col("y"))
    il, xl = g.lines(F.col("x"), F.col("y"))
    x, y = g.place(F.col("il"), F.col("xl"))
    rows = traces.select("*", i.alias("i"), j.alias("j"), ci.alias("ci"), cj.alias("cj"), il.alias("p"), xl.alias("q"), x.alias("u"), y.alias("v")).collect()
    assert len({(r.i, r.j) for r in rows}) == len(rows)
    for r in rows:
        assert (r.i, r.j, r.il, r.xl) == (r.ci, r.cj, r.p, r.q) and 0 <= r.i < g.nx and 0 <= r.j < g.ny
        assert (r.u, r.v) == pytest.approx((r.x, r.y), abs=0.05)
        a, c, s = g.angle, math.cos(g.angle), math.sin(g.angle)
        u, v = (r.i + 0.5) * g.dx, (r.j + 0.5) * g.dy
        assert (g.x0 + u * c - v * s, g.y0 + u * s + v * c) == pytest.approx((r.x, r.y), abs=0.1), a
    assert traces.limit(1).select(*g.cell_at(F.lit(-1e6), F.lit(0.0))).first() == (None, None)


def test_single_lines_and_errors(spark):
    one = survey(spark, n_il=1, turn=0)
    g = lateral.fitted(one)
    assert (g.nx, g.ny) == (1, 9) and g.dy == pytest.approx(30)
    assert one.select(*g.cell(F.col("il"), F.col("xl"))).distinct().count() == 9
    g = lateral.fitted(survey(spark, n_xl=1, turn=10))
    assert (g.nx, g.ny) == (7, 1) and math.degrees(g.angle) == pytest.approx(10, abs=0.05)
    with pytest.raises(ValueError, match="no traces"):
        lateral.fitted(one.where("false"))
    with pytest.raises(ValueError, match="same lines"):
        lateral.fitted(one.limit(1))
    moved = survey(spark).withColumn("x", F.col("x") + F.when(F.expr("il = 106 AND xl = 509"), 40.0).otherwise(0.0))
    with pytest.raises(ValueError, match="inline 106, crossline 509"):
        lateral.fitted(moved)


def test_regularised_axes_are_orthogonal(spark):
    traces = survey(spark, skew=0.2, n_il=4, n_xl=4)
    plain = lateral.fitted(traces)
    il, xl = plain.xy
    assert abs(np.dot(il, xl)) > 10
    il, xl = lateral.regularised(np.array(il), np.array(xl), np.array([[6.0, 9], [6, 0]]))
    assert np.dot(il, xl) == pytest.approx(0, abs=1e-9) and np.hypot(*il) == pytest.approx(25, abs=0.01) and np.hypot(*xl) == pytest.approx(10, abs=0.01)
    straight = survey(spark, skew=0.001)
    g = lateral.fitted(straight)
    assert g == lateral.fitted(straight, regularise=True)


def cells(spark, nx, ny, nz, missing=()):
    rows = [(i, j, k, None if (i, j, k) in missing else float(i + 10 * j + 100 * k)) for k in range(nz) for j in range(ny) for i in range(nx)]
    return spark.createDataFrame(rows, "i int, j int, k int, value double").repartition(4)


def test_storm_round_trip(spark, tmp_path):
    path, grid = str(tmp_path / "a.storm"), grids.Grid(4, 2, 3, 100.0, 200.0, 100.0, 100.0, 90.0, 1000.0, 1060.0)
    grids.write_storm(cells(spark, 4, 2, 3, {(2, 1, 1)}), path, grid)
    data = (tmp_path / "a.storm").read_bytes()
    head = b"storm_petro_binary\n0 0 -99999.000000\nFFTGrid\n100.000000 100.000000 200.000000 100.000000 1000.000000 1060.000000 0.0 0.0\n60.000000 90.000000\n\n4 2 3\n"
    want = np.array([[[i + 10 * j + 100 * k for i in range(4)] for j in range(2)] for k in range(3)], ">f4")
    want[1, 1, 2] = -99999
    assert data == head + want.tobytes() + b"0\n"
    got = grids.cube(spark, path, split=40)
    assert got.rdd.getNumPartitions() == 3
    for r in got.collect():
        assert r.value is None if (r.i, r.j, r.k) == (2, 1, 1) else r.value == r.i + 10 * r.j + 100 * r.k
        assert (r.x, r.y, r.z) == pytest.approx((100 - (r.j + 0.5) * 50, 200 + (r.i + 0.5) * 25, 1010 + 20 * r.k))
    assert got.count() == 24
    (tmp_path / "bad").write_bytes(data[:-20])
    with pytest.raises(Exception, match="values expected"):
        grids.cube(spark, str(tmp_path / "bad")).collect()
    (tmp_path / "worse").write_bytes(b"storm_petro_ascii\n")
    with pytest.raises(Exception, match="not a binary STORM"):
        grids.cube(spark, str(tmp_path / "worse")).collect()


@pytest.mark.parametrize("fault", ["lacks", "twice", "outside"])
def test_faulty_cells_leave_no_file(spark, tmp_path, fault):
    rows = cells(spark, 4, 2, 3)
    extra = spark.createDataFrame([(1, 1, 1 if fault == "twice" else 3, 0.5)], rows.schema)
    rows = rows.where("NOT (i = 1 AND j = 1 AND k = 1)") if fault == "lacks" else rows.union(extra)
    with pytest.raises(Exception, match={"lacks": "bytes expected", "twice": "two values", "outside": "outside the grid"}[fault]):
        grids.write_storm(rows, str(tmp_path / "a.storm"), grids.Grid(4, 2, 3, 0, 0, 1, 1))
    assert os.listdir(tmp_path) == []


def test_crava_round_trip(spark, tmp_path):
    path, grid = str(tmp_path / "a.crava"), grids.Grid(3, 2, 2, 10.0, 20.0, 6.0, 8.0, 30.0)
    grids.write_crava(cells(spark, 4, 3, 4), path, grid, (4, 3, 4), (1, 2, 0.5, 0, 0, 0.25))
    data = (tmp_path / "a.crava").read_bytes()
    tag = len(b"crava_fftgrid_binary\n")
    assert struct.unpack_from(">4d2i7d3i", data, tag) == pytest.approx((10, 20, 2, 4, 3, 2, 1, 2, 0.5, 0, 0, 0.25, math.radians(30), 6, 3, 4))
    values = np.frombuffer(data, ">f4", offset=tag + struct.calcsize(">4d2i7d3i")).reshape(4, 3, 6)
    assert (values[..., 4:] == 0).all() and values[3, 2, 1] == 321
    rows = grids.cube(spark, path, split=50).collect()
    assert len(rows) == 3 * 2 * 4 and all(r.value == r.i + 10 * r.j + 100 * r.k and r.z is None for r in rows)
    assert grids.cube(spark, path, padding=True).count() == 6 * 3 * 4


def test_a_task_that_fails_leaves_no_file(spark, tmp_path):
    ranges.shared_folder(spark)
    rows = spark.range(0, 100, 1, 4).select((F.col("id") * 4).alias("place"), F.when(F.col("id") == 77, F.raise_error(F.lit("lost"))).otherwise(F.lit("abcd")).cast("binary").alias("data"))
    with pytest.raises(Exception, match="lost"):
        ranges.write_one_file(rows, str(tmp_path / "x"), 400)
    assert os.listdir(tmp_path) == []


def test_kinds_of_files(spark, tmp_path):
    ranges.shared_folder(spark)
    grids.write_storm(cells(spark, 2, 2, 2), str(tmp_path / "a"), grids.Grid(2, 2, 2, 0, 0, 1, 1))
    grids.write_crava(cells(spark, 2, 2, 2), str(tmp_path / "b"), grids.Grid(2, 2, 2, 0, 0, 1, 1), (2, 2, 2))
    segy.write_segy(survey(spark), str(tmp_path / "c"), 0.0, 4.0, 12, kind=1)
    (tmp_path / "d").write_bytes(b"NORSAR General Grid Format v1.0\n")
    (tmp_path / "e").write_bytes(b"")
    assert [grids.grid_type(str(tmp_path / x)) for x in "abcde"] == ["storm", "crava", "segy", "sgri", "unknown"]


def test_trilinear_and_arithmetic(spark):
    from strataspark.operators import grids as G

    cube = cells(spark, 3, 3, 3, {(1, 1, 1)}).withColumn("value", F.when(F.expr("i = 2"), -5.0).otherwise(F.col("value")))
    held = {(r.i, r.j, r.k): max(r.value or 0.0, 0.0) for r in cube.collect()}
    at = [(12.0, 21.0, 31.5), (10.2, 20.4, 30.1), (16.0, 26.0, 36.0), (9.9, 21.0, 31.0), (14.9, 25.0, 35.0), (None, 21.0, 31.0)]
    points = spark.createDataFrame([(k, *p) for k, p in enumerate(at)], "id int, x double, y double, z double")
    got = {r.id: r.value for r in G.trilinear(cube, points, (10.0, 20.0, 30.0), (2.0, 2.0, 2.0), (3, 3, 3)).collect()}
    for k, p in enumerate(at[:3] + at[4:5]):
        k = k if k < 3 else 4
        u = [(v - lo) / 2 - 0.5 for v, lo in zip(p, (10, 20, 30), strict=True)]
        want = 0.0
        for step in np.ndindex(2, 2, 2):
            cell = tuple(math.floor(a) + d for a, d in zip(u, step, strict=True))
            want += held.get(cell, 0.0) * math.prod(a - math.floor(a) if d else 1 - (a - math.floor(a)) for a, d in zip(u, step, strict=True))
        assert got[k] == pytest.approx(want)
    assert got[3] is None and got[5] is None and len(got) == 6
    a, b = (spark.createDataFrame(x, "c int, v double") for x in ([(1, 2.0), (2, None), (3, 4.0)], [(1, 5.0), (2, 1.0), (9, 1.0)]))
    assert [{tuple(r) for r in G.arithmetic(a, b, ["c"], "v", how).collect()} for how in ("add", "subtract", "multiply")] == [{(1, 7.0), (2, None)}, {(1, -3.0), (2, None)}, {(1, 10.0), (2, None)}]


def test_headers_without_samples(spark, tmp_path):
    """samples="no" gives the same traces without amp, conditions included, and blocks of cubes stay small."""
    rows = [(100 + k // 9, 500 + k % 9, 10.0 * k, 5.0 * k, [float(k)] * 4) for k in range(90)]
    path = str(tmp_path / "s.sgy")
    segy.write_segy(spark.createDataFrame(rows, "il int, xl int, x double, y double, amp array<float>"), path, 0.0, 4.0, 4)
    whole, heads = (segy.read_segy(spark, path, split=2000, **o) for o in ({}, {"samples": "no"}))
    assert heads.columns == [c for c in whole.columns if c != "amp"]
    assert sorted(heads.where("xl > 503").collect()) == sorted(whole.drop("amp").where("xl > 503").collect())
    assert segy.read_segy(spark, path, samples="no", split=2000).count() == 90
    assert grids.CubeReader.block < segy.SegyReader.block < 4 << 20
