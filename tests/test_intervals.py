import numpy as np
import pytest
from pyspark.sql import functions as F

from strataspark.operators import intervals as V


def plainly_eroded(z, priorities):
    """Surfaces cut one after the other at one place."""
    out = {}
    for n in sorted(range(len(z)), key=lambda k: priorities[k]):
        v, below, above = z[n], [out[k] for k in sorted(out) if k > n], [out[k] for k in sorted(out, reverse=True) if k < n]
        if below and v is not None and below[0] is not None:
            v = min(v, below[0])
        if above and v is not None and above[0] is not None:
            v = max(v, above[0])
        out[n] = v
    return [out[n] for n in range(len(z))]


@pytest.mark.parametrize("priorities", [[1, 2, 3, 4], [4, 3, 2, 1], [1, 3, 2, 4], [3, 1, 4, 2]])
def test_erosion(spark, priorities):
    rng = np.random.default_rng(3)
    rows = [[None if rng.random() < 0.05 else float(v) for v in np.arange(4) * 10 + rng.normal(0, 15, 4)] for _ in range(200)]
    names = list("abcd")
    df = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "n int, a double, b double, c double, d double")
    got = V.eroded_in_order(df, names, priorities).orderBy("n").collect()
    assert [[r[c + "_eroded"] for c in names] for r in got] == [plainly_eroded(r, priorities) for r in rows]
    for r in got:
        kept = [r[c + "_eroded"] for c in names]
        if None not in kept:
            assert kept == sorted(kept) and kept[priorities.index(1)] == r[names[priorities.index(1)]]
    with pytest.raises(ValueError):
        V.eroded_in_order(df, names, [1, 1, 2, 3])


def test_visible_and_layers(spark):
    df = spark.createDataFrame([(0.0, 10.0, 20.0), (12.0, 10.0, 20.0), (0.0, 25.0, 20.0), (0.0, None, 20.0)], "a double, b double, c double")
    df = V.eroded_in_order(df, ["a", "b", "c"], [2, 1, 3])
    spans = V.visible(["a", "b", "c"])
    got = df.select(*[c.alias(f"s{k}") for k, c in enumerate(sum(map(list, spans), []))]).collect()
    # Where a lies below b, the first interval is empty at a as it was; where c lies above b, the second is empty at c as it was.
    assert [tuple(r) for r in got] == [(0, 10, 10, 20), (12, 12, 10, 20), (0, 25, 20, 20), (0, None, None, 20)]
    at = V.layer_of(F.col("z"), spans, [5, 4])
    points = df.limit(1).crossJoin(spark.createDataFrame([(-1.0,), (0.0,), (9.99,), (10.0,), (19.0,), (20.0,)], "z double"))
    assert [r.at and tuple(r.at) for r in points.select("z", at.alias("at")).orderBy("z").collect()] == [None, (0, 0, 0), (0, 4, 4), (1, 0, 5), (1, 3, 8), None]


def test_boxes(spark):
    df = spark.createDataFrame([(0.0, 10.0, 18.0, 18.0, 30.0), (0.0, 20.0, 24.0, 24.0, 20.0), (None, 5.0, 5.5, 5.5, 6.0)], "a double, b double, c double, d double, e double")
    spans = [(F.col(x), F.col(y)) for x, y in ("ab", "bc", "cd", "de")]
    got = {r.interval: r for r in V.interval_boxes(df, list("wxyz"), spans, [10, 4, 2, 2], 0.1, [1.0, 4.0, 1.0, 1.0]).collect()}
    assert tuple(got["w"])[2:] == (10, 0, 2, 20.0, 0.5, 2.0, 1.0, 2.0, "ok")
    assert (got["x"].status, got["x"].min_relative, got["x"].first_layer) == ("thin", 0.0625, 10)
    assert (got["y"].status, got["y"].dz_relative, got["z"].status) == ("empty", None, "crossing")
    nothing = V.interval_boxes(df.where("a > 99"), ["w"], spans[:1], [3]).first()
    assert (nothing.n_places, nothing.lz, nothing.status) == (0, None, "empty")


def test_extended(spark):
    df = spark.createDataFrame([(0.0, 10.0, 5.0), (4.0, 20.0, 6.0), (1.0, None, 5.0)], "a double, b double, c double")
    got = V.extended(df, "a", "b", "c").collect()
    assert [(r.top_extended, r.base_extended) for r in got] == [(0.0, 19.0), (1.0, 20.0), (None, None)]


def plain_blocks(cells, totals):
    """One sample after the other."""
    met, out, first = set(), [], None
    for c, t in zip(cells, totals, strict=True):
        if None in c:
            out.append(None)
            continue
        first = t if first is None else first
        met.add(c)
        out.append(first + len(met) - 1)
    return out


@pytest.mark.parametrize("stretch", [1, 7, 1 << 16])
def test_blocks(spark, stretch):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for well in ("hot", "b", "c"):
        n = {"hot": 400, "b": 40, "c": 1}[well]
        k = np.maximum(0, np.cumsum(rng.integers(-1, 3, n)) // 3)
        cells = [(None, None, None) if rng.random() < 0.1 else (int(x), 0, int(t)) for x, t in zip(rng.integers(0, 2, n), k, strict=True)]
        rows += [(well, m, *c, float(m), 0.1 * m if m % 3 else None) for m, c in enumerate(cells)]
        want |= {(well, m): b for m, b in enumerate(plain_blocks(cells, [c[2] for c in cells]))}
    df = spark.createDataFrame(rows, "well string, m int, i int, j int, k int, z double, por double").withColumn("extra", F.lit(1))
    got = V.blocks_along(df, "well", "m", ["i", "j", "k"], "k", stretch)
    assert {(r.well, r.m): r.block for r in got.collect()} == want
    blocked = {(r.well, r.block): r for r in V.interval_blocks(got, "well", "m", ["i", "j", "k"], ["z"], ["por"], ["z"]).collect()}
    assert set(blocked) == {(w, b) for (w, _), b in want.items() if b is not None}
    for (w, b), r in blocked.items():
        mine = sorted((x for x in rows if x[0] == w and want[w, x[1]] == b), key=lambda x: x[1])
        assert r.n == len(mine) and (r.i, r.j, r.k) == mine[0][2:5] and r.z == pytest.approx(np.mean([x[5] for x in mine]))
        por = [x[6] for x in mine if x[6] is not None]
        assert r.por == (pytest.approx(np.mean(por)) if por else None)
        logs = [np.log(x[5]) for x in mine if x[5] > 0]
        assert r.ln_z == (pytest.approx(np.mean(logs)) if logs else None)


def test_blocks_of_nothing(spark):
    df = spark.createDataFrame([("a", 0, None), ("a", 1, None)], "well string, m int, k int")
    got = V.blocks_along(df, "well", "m", ["k"], "k")
    assert [r.block for r in got.collect()] == [None, None]
    assert V.blocks_along(df.limit(0), "well", "m", ["k"], "k").count() == 0


def test_extents(spark):
    df = spark.createDataFrame([("a", m, 1 if m > 1 else 0, k, b) for m, k, b in [(0, 3, 3), (1, 4, 4), (2, 0, 5), (3, 1, 6)]], "well string, m int, s int, k int, block long")
    assert tuple(V.well_extents(df, "well", "m", "s", "k", [5, 4]).first()) == ("a", 0, 1, 3, 1, 4, 9)


@pytest.mark.parametrize("stretch", [1, 5, 1000])
def test_numbered(spark, stretch):
    df = spark.createDataFrame([("a" if k % 3 else "b", k * k, k) for k in range(30)], "w string, o long, extra int")
    got = V.numbered(df, "w", "o", "n", stretch).collect()
    for w in "ab":
        mine = sorted((r.o, r.n) for r in got if r.w == w)
        assert [n for _, n in mine] == list(range(len(mine)))
    assert len(got) == 30
