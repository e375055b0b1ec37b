import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataspark.operators import lateral
from strataspark.sources import files, texts

XYZ, FIVE = "some words\nX Y Z\n1.0 2.0 3.5\n2 2 -999.25\n\n", "UTMX  Inline Attribute UTMY Crossline\n455380.0 2100 2467.5 6799690.0 5600\n447256.0 2100 -999.25 6799789.0 5640\n455517 2120 2338 6810939.5 5640.0\n"


def put(folder, **contents):
    for name, text in contents.items():
        (folder / name).write_bytes(text if isinstance(text, bytes) else text.encode("latin-1"))


def test_kinds(spark, tmp_path):
    put(tmp_path, a="\n -996 2 50 25\n", b=b"STORMGRID_BINARY\n\n1 1 1 1\n0 0 0 0\n" + struct.pack(">d", 1), c="NORSAR SGRI file format v1.0\n", d="NORSAR other\n1 2 3\n", e=XYZ, f=FIVE, g="", h="words only\n")
    got = {os.path.basename(r.path): r.kind for r in texts.surface_kinds(spark, str(tmp_path)).collect()}
    assert got == {"a": "irap", "b": "storm", "c": "sgri", "d": "unknown", "e": "xyz", "f": "multicolumn", "h": "unknown"}


def test_text_surfaces(spark, tmp_path):
    put(tmp_path, a=XYZ, b="5 6 7\n", five=FIVE)
    got = {(os.path.basename(r.path), r.n): (r.x, r.y, r.z, r.il, r.xl) for r in texts.text_surface(spark, str(tmp_path / "[ab]")).collect()}
    assert got == {("a", 0): (1, 2, 3.5, None, None), ("a", 1): (2, 2, None, None, None), ("b", 0): (5, 6, 7, None, None)}
    five = texts.text_surface(spark, str(tmp_path / "five"), 5)
    assert [tuple(r)[2:] for r in five.orderBy("n").collect()] == [(455380.0, 6799690.0, 2467.5, 2100, 5600), (447256.0, 6799789.0, None, 2100, 5640), (455517.0, 6810939.5, 2338.0, 2120, 5640)]
    assert [(r.i, r.j) for r in texts.on_lines(five).orderBy("n").collect()] == [(0, 0), (0, 1), (1, 1)]


@pytest.mark.parametrize(("text", "match"), [("X Y Z\n1 2 3\n1 2\n", "expected 3 numbers"), ("X A Z\n1 2 3\n", "no column Y"), ("a\nb\n", "no line of 3 numbers|no column")])
def test_wrong_text_surfaces(spark, tmp_path, text, match):
    put(tmp_path, a=text)
    with pytest.raises(Exception, match=match):
        texts.text_surface(spark, str(tmp_path / "a")).collect()


def test_lines_that_are_not_even(spark):
    nodes = spark.createDataFrame([("s", 0, 0), ("s", 2, 0), ("s", 5, 0)], "path string, il int, xl int")
    with pytest.raises(Exception, match="evenly"):
        texts.on_lines(nodes).collect()


LAS = "~Version\n VERS. 2.0 : x\n WRAP. {} : y\n~Well\n#c\n NULL. -9999 : missing\n WELL. A B 7 : name\n~Curve\n DEPT.M : depth\n TWT.MS : t\n DT.US/F : s\n EASTING.M : e\n NORTHING.M : n\n~A\n"


def test_las_wells(spark, tmp_path):
    put(tmp_path, a=LAS.format("NO") + "1 100 100 5 6\n2 -9999 90 5 6\n3 102 -999.25 5 6\n", b=LAS.format("YES").replace("A B 7", "W") + "1\n100 100\n5 6\n")
    got = texts.las_wells(spark, str(tmp_path / "*"), ["twt", "DT", "Easting", "northing", "rho", "vs"])
    assert sorted(tuple(r) for r in got.collect()) == [("A B 7", 0, 100, 100, 5, 6, None, None), ("A B 7", 1, None, 90, 5, 6, None, None), ("A B 7", 2, 102, None, 5, 6, None, None), ("W", 0, 100, 100, 5, 6, None, None)]
    ready = texts.prepared_logs(got, "TWT", "DT", "vs", "rho", porosity="phi", slowness=(True, True)).where("well <> 'W'").orderBy("seq").collect()
    assert [tuple(r) for r in ready] == [("A B 7", 0, 5, 6, 100, 3048, None, None, None), ("A B 7", 2, 5, 6, 102, None, None, None, None)]
    far = texts.prepared_logs(got, "TWT", "DT", "vs", "rho", facies="DT", kilometres=True).where("well = 'W'").first()
    assert (far.x, far.y, far.z, far.vp, far.facies) == (5000, 6000, 100000, 100, 100)
    with pytest.raises(ValueError, match="no log for time"):
        texts.prepared_logs(got, "Z", "DT", "vs", "rho")
    put(tmp_path, c=LAS.format("NO") + "1 100 100 5\n")
    with pytest.raises(Exception, match="4 numbers for 5 curves"):
        texts.las_wells(spark, str(tmp_path / "c"), ["twt"]).collect()


def test_rms_round_trip(spark, tmp_path):
    rows = [(w, s, 10.5 + s, -3.25, 1000.0 + s, None if s == 2 else 2.5 * s, s % 2) for w, n in (("A 1/b", 40), ("C", 1)) for s in range(n)]
    df = spark.createDataFrame(rows, "well string, seq int, x double, y double, z double, vp double, facies int")
    texts.write_rms_wells(df.repartition(7), str(tmp_path / "w"), ["vp"], {0: "sand", 1: "shale"})
    assert sorted(os.listdir(tmp_path / "w")) == ["A_1_b.rms", "C.rms"]
    got = files.rms_wells(spark, str(tmp_path / "w" / "*.rms"), ["vp", "facies"])
    assert sorted(tuple(r) for r in got.collect()) == sorted((r[0].replace(" ", "_").replace("/", "_"), *r[1:]) for r in rows)
    assert sorted(tuple(r) for r in files.facies_names(spark, str(tmp_path / "w")).collect()) == [(0, "sand"), (1, "shale")]


@pytest.mark.parametrize("broken", ["seq <> 5", "TRUE"])
def test_rms_leaves_no_file(spark, tmp_path, broken):
    df = spark.range(20).select(F.lit("a").alias("well"), F.col("id").alias("seq"), *[F.lit(1.0).alias(c) for c in "xyz"])
    df = df.where(broken) if "seq" in broken else df.union(df.where("seq = 3"))
    with pytest.raises(Exception, match="missing or twice"):
        texts.write_rms_wells(df, str(tmp_path / "w"), [])
    assert os.listdir(tmp_path / "w") == []


GRIDS = [("top", 7, 3, 50.0, 25.0, 10.0, 20.0, 30.0), ("base", 1, 1, 5.0, 5.0, 0.0, -5.0, 0.0), ("mid", 6, 2, 10.0, 20.0, 1.0, 2.0, 0.0)]


def surfaces(spark, names):
    grids = spark.createDataFrame([g for g in GRIDS if g[0] in names], "name string, nx int, ny int, dx double, dy double, x0 double, y0 double, angle double")
    rng = np.random.default_rng(1)
    rows = [(n, i, j, None if (i + j) % 5 == 4 else round(float(rng.normal(0, 1000)), 4)) for n, nx, ny, *_ in GRIDS if n in names for i in range(nx) for j in range(ny)]
    return grids, rows, spark.createDataFrame(rows, "name string, i int, j int, z double")


def test_irap_round_trip(spark, tmp_path):
    grids, rows, nodes = surfaces(spark, ["top", "base", "mid"])
    texts.write_irap_surfaces(nodes.repartition(5), grids, str(tmp_path / "s"))
    got = files.irap_surface(spark, str(tmp_path / "s")).collect()
    assert {(os.path.basename(r.path)[:-5], r.i, r.j): r.z for r in got} == {r[:3]: r[3] for r in rows}
    assert {r.kind for r in texts.surface_kinds(spark, str(tmp_path / "s")).collect()} == {"irap"}
    x, y = next((r.x, r.y) for r in got if r.path.endswith("top.irap") and (r.i, r.j) == (1, 2))
    assert (x, y) == pytest.approx((10 + 50 * np.cos(np.pi / 6) - 50 * np.sin(np.pi / 6), 20 + 50 * np.sin(np.pi / 6) + 50 * np.cos(np.pi / 6)))
    with pytest.raises(Exception, match="missing or twice"):
        texts.write_irap_surfaces(nodes.where("NOT (name = 'mid' AND i = 5 AND j = 1)"), grids, str(tmp_path / "t"))
    assert os.listdir(tmp_path / "t") == []
    with pytest.raises(Exception, match="outside the grid"):
        texts.write_irap_surfaces(nodes.withColumn("i", F.col("i") + 1), grids, str(tmp_path / "t"))
    with pytest.raises(Exception, match="more than 16"):
        texts.write_irap_surfaces(nodes.withColumn("z", F.lit(1e15)), grids, str(tmp_path / "t"))


def test_storm_round_trip(spark, tmp_path):
    grids, rows, nodes = surfaces(spark, ["base", "mid"])
    texts.write_storm_surfaces(nodes.repartition(5), grids, str(tmp_path / "s"))
    got = texts.storm_surface(spark, str(tmp_path / "s")).collect()
    assert {(os.path.basename(r.path)[:-6], r.i, r.j): r.z for r in got} == {r[:3]: r[3] for r in rows}
    assert next((r.x, r.y) for r in got if "mid" in r.path and (r.i, r.j) == (3, 1)) == (31, 22)
    assert {r.kind for r in texts.surface_kinds(spark, str(tmp_path / "s")).collect()} == {"storm"}
    with pytest.raises(Exception, match="can't be turned"):
        texts.write_storm_surfaces(nodes, grids.withColumn("angle", F.lit(1.0)), str(tmp_path / "t"))
    put(tmp_path, cut=b"STORMGRID_BINARY\n\n2 2 1 1\n0 1 0 1\n" + bytes(24))
    with pytest.raises(Exception, match="2 x 2 values expected, 3 found"):
        texts.storm_surface(spark, str(tmp_path / "cut")).collect()


def test_jason_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", -4.0, 4.0, [0.5, 1.0, -0.25]), ("b", -8.0, 2.0, [1.0])], "name string, shift double, dz double, amp array<double>")
    texts.write_jason_wavelets(df, str(tmp_path / "w"))
    got = files.jason_wavelet(spark, str(tmp_path / "w" / "a.txt")).orderBy("k").collect()
    assert [(r.shift, r.dz, r.amp) for r in got] == [(-4, 4, 0.5), (-4, 4, 1.0), (-4, 4, -0.25)]
    assert files.jason_wavelet(spark, str(tmp_path / "w")).count() == 4


def test_lines_from_coordinates(spark, tmp_path):
    traces = spark.createDataFrame([(p * 9 + q, 100 + 2 * p, 500 + 3 * q, 1000.0 + 40 * p - 18 * q, 2000.0 + 30 * p + 24 * q) for p in range(5) for q in range(9)], "trace int, il int, xl int, x double, y double")
    corners = [(100, 500), (108, 500), (100, 524), (108, 524)]
    at = {(r.il, r.xl): (r.x, r.y) for r in traces.collect()}
    put(tmp_path, s="X Y Z\n" + "".join(f"{at[c][0]} {at[c][1]} {k}\n" for k, c in enumerate(corners)))
    got = texts.on_lines(texts.text_surface(spark, str(tmp_path / "s")), lateral.fitted(traces)).orderBy("n").collect()
    assert [(r.il, r.xl, r.i, r.j) for r in got] == [(il, xl, int(il > 100), int(xl > 500)) for il, xl in corners]


def test_surfaces_are_split(spark, tmp_path):
    """Files of several splits, header lines with blanks among them, a name that a path would encode; the same rows as in one piece."""
    rng, (nx, ny) = np.random.default_rng(2), (61, 83)
    z = np.round(rng.normal(0, 1000, nx * ny), 3)
    z[::11] = 9999900.0
    lines = ["-996 83 10 20", "", "5.0 605.0 7.0 1647.0", "61 30.0 5.0 7.0", " 0 any words here 0 "]
    at = 0
    while at < len(z):
        n = int(rng.integers(0, 9))
        lines.append(" ".join(f"{v:.3f}" for v in z[at : at + n]))
        at += n
    os.mkdir(tmp_path / "i")
    put(tmp_path / "i", **{"a b%20+c.irap": "\r\n".join(lines) + "\n", "one.irap": "-996 1 1 1\n0 0 0 0\n1 0 0 0\n0\n4.5"})
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        df = files.irap_surface(spark, str(tmp_path / "i"))
        assert df.rdd.getNumPartitions() > 5
        got = df.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r.path for r in got} == {r.path for r in texts.surface_kinds(spark, str(tmp_path / "i")).collect()} == {f"file:{tmp_path}/i/a b%20+c.irap", f"file:{tmp_path}/i/one.irap"}
    assert [(r.i, r.j, r.z) for r in got if "one" in r.path] == [(0, 0, 4.5)]
    found = {(r.i, r.j): r for r in got if "one" not in r.path}
    assert len(found) == len(got) - 1 == nx * ny
    assert {k: r.z for k, r in found.items()} == {(k % nx, k // nx): None if v >= 9999900 else v for k, v in enumerate(z.tolist())}
    c, s = np.cos(np.pi / 6), np.sin(np.pi / 6)
    assert (found[3, 4].x, found[3, 4].y) == pytest.approx((5 + 30 * c - 80 * s, 7 + 30 * s + 80 * c))
    put(tmp_path, cut="\n".join(lines[:-2]), other="1 2 3\n" * 9)
    with pytest.raises(Exception, match="61 x 83 values expected"):
        files.irap_surface(spark, str(tmp_path / "cut")).count()
    with pytest.raises(Exception, match="not an Irap classic surface"):
        files.irap_surface(spark, str(tmp_path / "other")).count()


def test_storm_surfaces_are_split(spark, tmp_path):
    z = np.random.default_rng(3).normal(size=37 * 51)
    z[::7] = -999
    put(tmp_path, **{"a b%20.storm": b"STORMGRID_BINARY\n\n37 51 2 3\n1 73 5 155\n" + z.astype(">f8").tobytes()})
    df = texts.storm_surface(spark, str(tmp_path), split=1000)
    assert df.rdd.getNumPartitions() > 10
    got = df.collect()
    assert len(got) == len(z)
    assert {(r.i, r.j): (r.x, r.y, r.z) for r in got} == {(k % 37, k // 37): (1 + 2.0 * (k % 37), 5 + 3.0 * (k // 37), None if v == -999 else v) for k, v in enumerate(z.tolist())}
    assert {r.path for r in got} == {r.path for r in texts.surface_kinds(spark, str(tmp_path)).collect()}


@pytest.mark.parametrize("kind", ["irap", "storm"])
def test_surfaces_in_a_store_of_spark_only(spark, tmp_path, kind):
    """A mounted path that pyarrow.fs can't open."""
    grids, rows, nodes = surfaces(spark, ["base", "mid"])
    {"irap": texts.write_irap_surfaces, "storm": texts.write_storm_surfaces}[kind](nodes, grids, str(tmp_path / "s"))
    spark.sparkContext._jsc.hadoopConfiguration().set(f"fs.viewfs.mounttable.{kind}.link./in", f"file://{tmp_path}")
    got = {"irap": files.irap_surface, "storm": texts.storm_surface}[kind](spark, f"viewfs://{kind}/in/s").collect()
    assert {(os.path.basename(r.path).split(".")[0], r.i, r.j): r.z for r in got} == {r[:3]: r[3] for r in rows}
    assert {r.path for r in got} == {r.path for r in texts.surface_kinds(spark, f"viewfs://{kind}/in/s").collect()}
