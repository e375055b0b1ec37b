"""Queries of cubes in files, the prior model, wavelets, and the inversion by frequency, over the driver's tables.

Traces of a survey are the vectors of `embeddings`; cells of a cube are users, hours and days of `events`; wells are its
users, layers its days."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from strataspark.functions import elastic as E
from strataspark.functions import inclusions
from strataspark.operators import cokriging, density, lateral, prior, spectral, trend, wavelets, well_filter
from strataspark.operators import grids as G
from strataspark.operators import logs as L
from strataspark.sources import grids, segy
from strataspark.sources.ranges import shared_file
from strataspark.streaming import state4d

from .reference_queries import BLOCKS, ORACLES, QUERIES, WAVELET, blocks, query, read, rounded

__all__ = ["ORACLES", "QUERIES"]
LINES = 25
TRACES = f"""t AS (SELECT CAST(100 + 2 * (vec_id // {LINES}) AS INT) AS il, CAST(500 + 3 * (vec_id % {LINES}) AS INT) AS xl,
  1e3 + 40 * (vec_id // {LINES}) - 18 * (vec_id % {LINES}) AS x, 2e3 + 30 * (vec_id // {LINES}) + 24 * (vec_id % {LINES}) AS y, embedding AS amp FROM embeddings)"""


def survey(spark, sf_dir) -> str:
    """A SEGY file of the embeddings: a survey turned by the angle of a 3-4-5 triangle."""
    p, q = F.floor(F.col("vec_id") / LINES), F.col("vec_id") % LINES
    vectors = read(spark, sf_dir, "embeddings")
    traces = vectors.select((100 + 2 * p).alias("il"), (500 + 3 * q).alias("xl"), (1000.0 + 40 * p - 18 * q).alias("x"), (2000.0 + 30 * p + 24 * q).alias("y"), F.col("embedding").alias("amp"))
    path = shared_file(spark, "survey.sgy")
    segy.write_segy(traces, path, 0.0, 4.0, vectors.agg(F.max(F.size("embedding"))).first()[0])
    return path


@query(f"WITH {TRACES} SELECT il, xl, x, y, CAST(len(amp) AS INT) AS n, round(list_sum(CAST(amp AS DOUBLE[])), 5) + 0.0 AS total, CAST(list_max(amp) AS DOUBLE) AS highest FROM t WHERE xl >= 512")
def segy_round_trip(spark, sf_dir):
    rows = segy.read_segy(spark, survey(spark, sf_dir)).where("xl >= 512")
    total = F.aggregate("amp", F.lit(0.0), lambda s, v: s + v.cast("double"))
    return rows.select("il", "xl", "x", "y", F.size("amp").alias("n"), (F.round(total, 5) + 0.0).alias("total"), F.array_max("amp").cast("double").alias("highest"))


@query(f"""WITH {TRACES} SELECT CAST((max(il) - min(il)) // 2 + 1 AS INT) AS nx, {LINES} AS ny, 5e1 AS dx, 3e1 AS dy, round(atan2(30, 40), 6) AS angle, 1e3 - (40 - 18) / 2e0 AS x0, 2e3 - (30 + 24) / 2e0 AS y0,
count(*) AS n_traces, CAST(count(DISTINCT il * 100000 + xl) AS BIGINT) AS n_cells FROM t""")
def survey_geometry(spark, sf_dir):
    traces = segy.read_segy(spark, survey(spark, sf_dir), samples="no")
    g = lateral.fitted(traces)
    i, j = g.cell_at(F.col("x"), F.col("y"))
    found = traces.agg(F.count("*").alias("n_traces"), F.countDistinct(F.struct(i, j)).alias("n_cells"))
    return rounded(found.select(*[F.lit(getattr(g, c)).alias(c) for c in ("nx", "ny", "dx", "dy", "angle", "x0", "y0")], "n_traces", "n_cells"))


CELLS = """SELECT CAST(h AS INT) AS i, CAST(u AS INT) AS j, CAST(d AS INT) AS k, CAST(CAST(max(value) AS FLOAT) AS DOUBLE) AS value
FROM range(0, 24) a(h), (SELECT unnest(range(0, max(user_id) + 1)) AS u FROM events), range(0, 31) c(d) LEFT JOIN events ON hour(ts) = h AND user_id = u AND day(ts) = d + 1 GROUP BY h, u, d"""


def _cube(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    ny = events.agg(F.max("user_id")).first()[0] + 1
    value = events.groupBy(F.hour("ts").alias("i"), F.col("user_id").alias("j"), (F.dayofmonth("ts") - 1).alias("k")).agg(F.max("value").alias("value"))
    at = spark.range(24 * ny * 31).select((F.col("id") % 24).alias("i"), (F.floor(F.col("id") / 24) % ny).alias("j"), F.floor(F.col("id") / (24 * ny)).alias("k"))
    return at.join(value, ["i", "j", "k"], "left"), grids.Grid(24, ny, 31, 0.0, 0.0, 24.0, float(ny), 0.0, 0.0, 31.0)


@query(CELLS)
def storm_round_trip(spark, sf_dir):
    cells, grid = _cube(spark, sf_dir)
    path = shared_file(spark, "cube.storm")
    grids.write_storm(cells, path, grid)
    return grids.cube(spark, path).select("i", "j", "k", "value")


@query(CELLS)
def crava_round_trip(spark, sf_dir):
    cells, grid = _cube(spark, sf_dir)
    path = shared_file(spark, "cube.crava")
    grids.write_crava(cells, path, grid, (grid.nx, grid.ny, grid.nz))
    return grids.cube(spark, path).select("i", "j", "k", "value")


_LOGS = ("ln_vp", "ln_vs", "ln_rho")


@query(f"""WITH {BLOCKS}, m AS (SELECT avg(ln_vp) AS a, avg(ln_vs) AS b, avg(ln_rho) AS c FROM blocks), r AS (SELECT well, block, n, [ln_vp - a, ln_vs - b, ln_rho - c] AS v FROM blocks, m),
s AS (SELECT lag, p, q, x.n * y.n AS w, x.v[p + 1] AS a, y.v[q + 1] AS b FROM r x JOIN r y ON x.well = y.well, range(0, 9) l(lag), range(0, 3) i(p), range(0, 3) j(q) WHERE y.block = x.block + lag)
SELECT CAST(lag AS INT) AS lag, CAST(p AS INT) AS p, CAST(q AS INT) AS q, count(*) AS n, CAST(sum(w) AS DOUBLE) AS weight, round(sum(w * a * b) / sum(w), 8) + 0.0 AS covariance FROM s WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY lag, p, q""")
def prior_auto_covariance(spark, sf_dir):
    rows = prior.residuals(blocks(spark, sf_dir), list(_LOGS))
    return rounded(prior.auto_covariances(rows, ["well"], "block", list(_LOGS), 8, "n"), 8)


def _wells(spark, sf_dir):
    """Blocks with the impedance of near offsets and a seismic trace made of it."""
    a = E.reflection_row(5.0)
    rows = blocks(spark, sf_dir).select("well", "block", sum((c * F.col(v) for c, v in zip(a, _LOGS, strict=True)), F.lit(0.0)).alias("e"))
    rows = L.reflections(rows.where("e IS NOT NULL"), ["well"], "block", F.col("e"), "r")
    return L.convolve(rows, ["well"], "block", "r", WAVELET, "s")


@query()
def estimated_wavelet(spark, sf_dir):
    """Wavelets of all wells whose run is long enough, each with how well the average explains its trace."""
    wells = wavelets.aligned_wells(_wells(spark, sf_dir), ["well"], "block", "e", "s", 6).drop("start", "length")
    by_well, average = wavelets.estimated(wells, ["well"], 64, 4.0, 48.0, 12.0)
    found = wavelets.signal_to_noise(wells, by_well, ["well"], average, 4.0).join(by_well, "well")
    return rounded(found.select("well", "weight", "shift", "n", "ratio", "scale", F.lit(float(average[0])).alias("average_at_0"), F.get("wavelet", F.lit(0)).alias("own_at_0")))


@query()
def frequency_inversion(spark, sf_dir):
    """Posterior of a cube whose places are wells and whose layers are days, with the prior estimated from the wells, and one draw."""
    angles, nz, nx = (5.0, 20.0), 32, 12
    rows = prior.residuals(blocks(spark, sf_dir), list(_LOGS))
    lags, n = prior.lag_matrices(prior.auto_covariances(rows, ["well"], "block", list(_LOGS), 8), 3, 8)
    lags[0] = prior.well_conditioned(lags[0])
    pulse = np.zeros((2, nz))
    pulse[:, [-1, 0, 1]] = WAVELET
    reflection = np.array([E.reflection_row(a) for a in angles])
    model = spectral.Model(reflection, pulse, prior.cyclic(lags[: max(n, 1)], nz), np.diag([1e-3, 2e-3]), 0.1, low=-1)
    last = read(spark, sf_dir, "events").agg(F.max("user_id")).first()[0]
    ny = last // nx + 1
    at = spark.range(nx * ny).select((F.col("id") % nx).cast("int").alias("i"), F.floor(F.col("id") / nx).cast("int").alias("j"), F.col("id").alias("well"))
    days = rows.groupBy("well").agg(F.map_from_entries(F.collect_list(F.struct(F.col("block").cast("int"), F.struct(*_LOGS)))).alias("d"))
    log = lambda c: F.transform(F.sequence(F.lit(0), F.lit(nz - 1)), lambda k: F.coalesce(F.try_element_at("d", k)[c], F.lit(0.0)))

    def stack(a: list[float]):
        two = F.zip_with(log("ln_vp"), log("ln_vs"), lambda x, y: a[0] * x + a[1] * y)
        return F.zip_with(two, log("ln_rho"), lambda x, y: x + a[2] * y)

    traces = at.join(days, "well", "left").select("i", "j", F.concat(*[stack(a) for a in reflection.tolist()]).alias("data"), F.array_repeat(F.lit(0.0), 3 * nz).alias("prior"))
    shape = spectral.Shape(nx + 4, ny + 2, nz, len(angles) + 4 + 3)
    found, _ = spectral.inverted(traces, nx, ny, shape, model, lambda i, j: np.exp(-0.5 * np.hypot(i, j)), simulations=1, seed=1)
    cut = lambda c, a: F.transform(F.slice(c, a * nz + 1, nz), lambda v: F.round(v, 6) + 0.0)
    return found.select("i", "j", *[cut("mean", k).alias(v) for k, v in enumerate(("vp", "vs", "rho"))], cut("simulated", 0).alias("drawn_vp"), cut("residual", 0).alias("residual"))


def _places(rows):
    """Wells' blocks with their place on a map of ten wells a line."""
    return rows.withColumns({"x": (F.col("well") % 10).cast("double"), "y": F.floor(F.col("well") / 10).cast("double"), "z": F.col("block").cast("double")})


@query()
def block_cokriging(spark, sf_dir):
    """Residuals of three logs, co-kriged onto every place and day of the wells' map."""
    rows = _places(prior.residuals(blocks(spark, sf_dir), list(_LOGS)))
    r = rows.agg(*[F.covar_pop(a, b) for a in _LOGS for b in _LOGS], F.max("y"), F.max("z")).first()
    cov = prior.well_conditioned(np.array(r[:9]).reshape(3, 3))
    line = lambda n: F.explode(F.sequence(F.lit(0), F.lit(int(n))).cast("array<double>"))
    targets = spark.range(10).select(F.col("id").cast("double").alias("x")).withColumn("y", line(r[9])).withColumn("z", line(r[10]))
    decay = lambda dx, dy, dz: np.exp(-3 * np.sqrt((dx / 4) ** 2 + (dy / 4) ** 2 + (dz / 3) ** 2))
    return rounded(cokriging.krige_blocks(rows, targets, [], ["x", "y", "z"], list(_LOGS), cov, decay, [5.0, 5.0, 8.0], [4.0, 4.0, 3.0], 60))


_BIN = "CAST(least(floor(({v} - ({v}_lo - 5 * {v}_s)) / (({v}_hi - {v}_lo + 10 * {v}_s) / {n})), {n} - 1) AS INT) AS {c}"
_NUMBERS = ", ".join(f"min({v}) AS {v}_lo, max({v}) AS {v}_hi, greatest(pow(4 / 7.0, 1 / 7.0) * pow(count(*), -1 / 7.0) * stddev_samp({v}), 1e-6) AS {v}_s" for v in _LOGS)


@query(f"""WITH {BLOCKS}, s AS (SELECT * FROM blocks WHERE ln_vp IS NOT NULL AND ln_vs IS NOT NULL AND ln_rho IS NOT NULL AND facies IS NOT NULL), m AS (SELECT {_NUMBERS} FROM s)
SELECT facies, {", ".join(_BIN.format(v=v, n=n, c=c) for v, n, c in zip(_LOGS, (12, 10, 8), "abc", strict=True))}, count(*) AS n FROM s, m GROUP BY ALL""")
def facies_bins(spark, sf_dir):
    rows = blocks(spark, sf_dir)
    return density.counted(rows, "facies", list(_LOGS), density.volume(rows, "facies", list(_LOGS), bins=(12, 10, 8)))


@query()
def facies_density(spark, sf_dir):
    """Probabilities of facies in every block, from densities on 100 x 100 x 50 bins smoothed with the best bandwidth."""
    rows = blocks(spark, sf_dir)
    box = density.volume(rows, "facies", list(_LOGS))
    found = density.densities(rows, "facies", list(_LOGS), box)
    shares = {r.facies: r.n for r in rows.where("facies IS NOT NULL").groupBy("facies").agg(F.count("*").alias("n")).collect()}
    prior_share = {f: n / sum(shares.values()) for f, n in shares.items()}
    return rounded(density.probabilities(rows.select("well", "block", "facies", *_LOGS), list(_LOGS), found, box, prior_share))


_NZ = 40


@query(f"""WITH {BLOCKS}, l AS (SELECT block AS k, avg(exp(ln_vp)) AS m, count(*) AS n FROM blocks WHERE ln_vp IS NOT NULL GROUP BY block), b AS (SELECT min(k) AS first, max(k) AS last, (SELECT greatest(12, 5 * count(DISTINCT well)) FROM blocks) AS least FROM l),
r AS (SELECT k, (SELECT coalesce(min(r), {_NZ}) FROM range(0, {_NZ} + 1) x(r) WHERE (SELECT coalesce(sum(n), 0) FROM l WHERE l.k BETWEEN g.k - r AND g.k + r) >= CASE WHEN g.k BETWEEN first AND last THEN least ELSE 2 * least END) AS r FROM range(0, {_NZ}) g(k), b),
s AS (SELECT r.k, sum(n) AS n, sum(n * l.k) / sum(n) AS x, sum(n * m) / sum(n) AS y, sum(n * l.k * l.k) / sum(n) AS xx, sum(n * l.k * m) / sum(n) AS xy, count(*) AS c FROM r JOIN l ON l.k BETWEEN r.k - r.r AND r.k + r.r GROUP BY r.k)
SELECT k AS block, round(CASE WHEN c = 1 THEN y ELSE y + (xy - x * y) / (xx - x * x) * (k - x) END, 5) AS trend, CASE WHEN c = 1 THEN 'mean' ELSE 'line' END AS kind FROM s""")
def local_trend(spark, sf_dir):
    rows = blocks(spark, sf_dir)
    layers = trend.layer_means(rows.withColumn("vp", F.exp("ln_vp")), [], "block", "vp")
    wells = rows.select("well").distinct().count()
    return rounded(trend.local_lines(layers, [], "block", _NZ, trend.least_data(wells, 4.0), -1e9, 1e9), 5)


@query()
def effective_rock(spark, sf_dir):
    """Rocks of parts: a mineral with brine in flat pores and gas in round ones."""
    size, price = F.col("p_size") / 50, F.col("p_retailprice") / 2000
    pores = [(F.lit(2.3), F.lit(0.0), 0.05 + 0.4 * price, 0.3 * size), (F.lit(0.02), F.lit(0.0), F.lit(0.9), 0.1 * (1 - size))]
    rows = read(spark, sf_dir, "part").select("p_partkey", inclusions.dem(36.0 + 4 * price, 40.0 + 5 * price, pores).alias("e"))
    return rounded(rows.select("p_partkey", "e.k", "e.mu"))


@query()
def time_lapse_4d(spark, sf_dir):
    """Customers as cells, orders as vintages: the six-part state after all of them, and the current three parameters."""
    prior_ = state4d.Prior(np.zeros(6), np.diag([0.04, 0.05, 0.02, 0.01, 0.01, 0.005]), 1995.0)
    evolution = state4d.Evolution(np.array([0.9, 0.9, 0.95]), np.array([0.01, 0.0, -0.005]), np.diag([0.002, 0.002, 0.001]))
    years = 1995 + E.years_between(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date"))
    value = (F.col("o_totalprice") - 250000) / 1e6
    part = lambda k: F.when(F.col("o_orderkey") % 3 != k, value * (1 - 0.2 * k))
    rows = read(spark, sf_dir, "orders").select("o_custkey", years.alias("time"), F.array(*[part(k) for k in range(3)]).alias("data"), F.array(*[F.lit(0.05 + 0.01 * k) for k in range(3)]).alias("variance"))
    found = state4d.states(rows, ["o_custkey"], prior_, evolution)
    now = [F.get("mean", F.lit(k)) + F.get("mean", F.lit(k + 3)) for k in range(3)]
    spread = [sum((F.get("covariance", F.lit(6 * a + b)) for a in (k, k + 3) for b in (k, k + 3)), F.lit(0.0)) for k in range(3)]
    return rounded(found.select("o_custkey", "n", "time", *[v.alias(c) for v, c in zip(now, ("vp", "vs", "rho"), strict=True)], *[v.alias(f"var_{c}") for v, c in zip(spread, ("vp", "vs", "rho"), strict=True)]))


@query()
def filtered_wells(spark, sf_dir):
    """Residuals of three logs, filtered to what an inversion that halves the prior covariance would resolve."""
    rows = _places(prior.residuals(blocks(spark, sf_dir), list(_LOGS))).withColumns({c: F.col(c).cast("int") for c in "xyz"})
    r = rows.agg(*[F.covar_pop(a, b) for a in _LOGS for b in _LOGS]).first()
    cov = prior.well_conditioned(np.array(r).reshape(3, 3))
    decay = lambda share, range_: lambda di, dj, dk: share * np.exp(-np.sqrt(di**2 + dj**2 + (dk / range_) ** 2))[..., None, None] * cov
    found = well_filter.filtered(rows.select("well", "x", "y", "z", *_LOGS), ["well"], ("x", "y", "z"), list(_LOGS), decay(1.0, 3.0), decay(0.5, 2.0), 16, 16)
    return rounded(found.drop("error"))


@query(f"""WITH cells AS ({CELLS}), n AS (SELECT max(user_id) + 1 AS ny FROM events), p AS (SELECT p_partkey, p_retailprice % 26 AS x, CAST(p_size AS DOUBLE) AS y, p_partkey % 310 / 10 AS z FROM part),
c AS (SELECT p.*, ny, CAST(floor(x - 0.5) AS INT) + a AS i, CAST(floor(y - 0.5) AS INT) + b AS j, CAST(floor(z - 0.5) AS INT) + c AS k,
  (CASE a WHEN 1 THEN x - 0.5 - floor(x - 0.5) ELSE 1 - (x - 0.5 - floor(x - 0.5)) END) * (CASE b WHEN 1 THEN y - 0.5 - floor(y - 0.5) ELSE 1 - (y - 0.5 - floor(y - 0.5)) END) * (CASE c WHEN 1 THEN z - 0.5 - floor(z - 0.5) ELSE 1 - (z - 0.5 - floor(z - 0.5)) END) AS w
  FROM p, n, range(0, 2) r(a), range(0, 2) s(b), range(0, 2) t(c))
SELECT p_partkey, CASE WHEN x BETWEEN 0 AND 24 AND y BETWEEN 0 AND min(ny) AND z BETWEEN 0 AND 31 THEN round(sum(w * coalesce(value, 0)), 5) + 0e0 END AS value FROM c LEFT JOIN cells USING (i, j, k) GROUP BY p_partkey, x, y, z""")
def trilinear_lookup(spark, sf_dir):
    cells, grid = _cube(spark, sf_dir)
    cells = cells.withColumn("value", F.col("value").cast("float").cast("double"))
    points = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_retailprice") % 26).alias("x"), F.col("p_size").cast("double").alias("y"), (F.col("p_partkey") % 310 / 10).alias("z"))
    found = G.trilinear(cells, points, (0.0, 0.0, 0.0), (1.0, 1.0, 1.0), (grid.nx, grid.ny, grid.nz))
    return rounded(found.select("p_partkey", "value"), 5)


@query("""WITH a AS (SELECT l_partkey AS cell, max(l_quantity) AS v FROM lineitem GROUP BY 1), b AS (SELECT p_partkey AS cell, CASE WHEN p_size > 5 THEN p_retailprice END AS v FROM part)
SELECT cell, round(a.v - b.v, 6) AS v FROM a JOIN b USING (cell)""")
def grid_difference(spark, sf_dir):
    a = read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("cell")).agg(F.max("l_quantity").alias("v"))
    b = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("cell"), F.when(F.col("p_size") > 5, F.col("p_retailprice")).alias("v"))
    return rounded(G.arithmetic(a, b, ["cell"], "v", "subtract"))
