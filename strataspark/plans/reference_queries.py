"""Queries of the geostatistical operators over the driver's tables, each with DuckDB SQL where SQL can express it.

Wells are users of `events`, a block is a day, facies are event types; a value is missing where event_id is divisible
by 7. Grids come from `lineitem` and `orders`, facies samples from `embeddings`, zones from `region`."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.functions import elastic as E
from strataspark.operators import facies as P
from strataspark.operators import grids as G
from strataspark.operators import inversion as I
from strataspark.operators import logs as L
from strataspark.streaming.timelapse import updated_state

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
WAVELET = [-0.25, 1.0, -0.25]


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    velocity = 1300 + 12 * F.col("value")
    vp = F.when(F.col("event_id") % 7 != 0, E.allowed(velocity, 1300, 6000))
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("well"), "ts", "event_id", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long").alias("block"), F.col("event_type").alias("facies"),
        vp.alias("vp"), (velocity / 1.9 + F.col("event_id") % 50).alias("vs"), (1.5 + F.col("value") / 400).alias("rho"),
    )


SAMPLES = """samples AS (
  SELECT user_id AS well, ts, event_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS block, event_type AS facies,
         CASE WHEN event_id % 7 <> 0 AND 1300 + 12 * value BETWEEN 1300 AND 6000 THEN 1300 + 12 * value END AS vp,
         (1300 + 12 * value) / 1.9 + event_id % 50 AS vs, 1.5 + value / 400 AS rho
  FROM events)"""
BLOCKS = f"""{SAMPLES}, means AS (
  SELECT well, block, count(*) AS n, avg(ln(vp)) AS ln_vp, avg(ln(vs)) AS ln_vs, avg(ln(rho)) AS ln_rho FROM samples GROUP BY well, block),
counts AS (SELECT well, block, facies, count(*) AS c FROM samples GROUP BY ALL),
tied AS (SELECT well, block, list(facies ORDER BY facies) AS t FROM (SELECT *, max(c) OVER (PARTITION BY well, block) AS m FROM counts) WHERE c = m GROUP BY well, block),
blocks AS (SELECT means.*, t[CAST((block + 1) % len(t) AS INT) + 1] AS facies, len(t) AS n_tied FROM means JOIN tied USING (well, block))"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.block_logs(samples(spark, sf_dir), ["well"], "block", ["vp", "vs", "rho"], "facies")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, without negative zeros."""
    return df.select(*[(F.round(F.col(c), digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(f"""WITH {BLOCKS}
SELECT well, block, n, facies, CAST(n_tied AS INT) AS n_tied, round(exp(ln_vp + ln_rho), 4) AS ai, round(exp(ln_vs + ln_rho), 4) AS si, round(exp(ln_vp - ln_vs), 6) AS vpvs,
  round(0.5 * (exp(2 * (ln_vp - ln_vs)) - 2) / nullif(exp(2 * (ln_vp - ln_vs)) - 1, 0), 6) + 0.0 AS poisson, round(exp(ln_rho + 2 * ln_vs - 13.81551), 6) AS mu,
  round(exp(ln_rho) * (exp(2 * ln_vp - 13.81551) - 2 * exp(2 * ln_vs - 13.81551)), 6) + 0.0 AS "lambda",
  round(exp(2 * (ln_vp + ln_rho) - 13.81551) - 2 * exp(2 * (ln_vs + ln_rho) - 13.81551), 6) + 0.0 AS lambda_rho, round(exp(2 * (ln_vs + ln_rho) - 13.81551), 6) AS mu_rho
FROM blocks""")
def blocked_elastic_logs(spark, sf_dir):
    out = E.elastic_attributes(F.col("ln_vp"), F.col("ln_vs"), F.col("ln_rho"))
    digits = {"ai": 4, "si": 4}
    return blocks(spark, sf_dir).select("well", "block", "n", "facies", "n_tied", *[(F.round(v, digits.get(k, 6)) + 0.0).alias(k) for k, v in out.items()])


@query(f"WITH {BLOCKS} SELECT block, count(*) AS n_blocks, round(avg(ln_vp), 6) AS ln_vp, round(avg(ln_vs), 6) AS ln_vs, round(avg(ln_rho), 6) AS ln_rho FROM blocks GROUP BY block")
def vertical_trend(spark, sf_dir):
    return rounded(L.vertical_trend(L.block_logs(samples(spark, sf_dir), ["well"], "block", ["vp", "vs", "rho"]), "block", ["ln_vp", "ln_vs", "ln_rho"]))


@query(f"""WITH {SAMPLES}, placed AS (SELECT *, row_number() OVER (PARTITION BY well ORDER BY ts) AS p FROM samples),
around AS (SELECT *, max(CASE WHEN vp IS NOT NULL THEN p END) OVER (PARTITION BY well ORDER BY p) AS pa, min(CASE WHEN vp IS NOT NULL THEN p END) OVER (PARTITION BY well ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS pb FROM placed)
SELECT r.event_id, r.well, round(coalesce(r.vp, a.vp + (b.vp - a.vp) * (r.p - r.pa) / nullif(r.pb - r.pa, 0)), 6) AS vp_filled
FROM around r LEFT JOIN placed a ON r.well = a.well AND r.pa = a.p LEFT JOIN placed b ON r.well = b.well AND r.pb = b.p""")
def filled_log(spark, sf_dir):
    return rounded(L.fill_gaps(samples(spark, sf_dir), ["well"], "ts", "vp", "vp_filled").select("event_id", "well", "vp_filled"))


@query(f"""WITH {SAMPLES}, placed AS (SELECT well, CASE WHEN well % 10 <> 0 THEN vp END AS vp, row_number() OVER (PARTITION BY well ORDER BY ts) - 1 AS p FROM samples),
runs AS (SELECT well, p, p - row_number() OVER (PARTITION BY well ORDER BY p) AS g FROM placed WHERE vp IS NOT NULL),
sizes AS (SELECT well, min(p) AS start, count(*) AS length FROM runs GROUP BY well, g),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY well ORDER BY length DESC, start) AS k FROM sizes) WHERE k = 1)
SELECT w.well, CAST(coalesce(start, 0) AS BIGINT) AS start, CAST(coalesce(length, 0) AS BIGINT) AS length FROM (SELECT DISTINCT well FROM samples) w LEFT JOIN best b ON w.well = b.well""")
def longest_run(spark, sf_dir):
    """Wells whose number divides by 10 have no data."""
    rows = samples(spark, sf_dir).withColumn("vp", F.when(F.col("well") % 10 != 0, F.col("vp")))
    return L.longest_run(rows, ["well"], "ts", "vp")


@query("""WITH d AS (SELECT user_id AS well, event_id % 13 - lag(event_id % 13) OVER w AS dx, event_id % 7 - lag(event_id % 7) OVER w AS dy, value - lag(value) OVER w AS dz FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))
SELECT well, round(max(degrees(atan2(sqrt(dx * dx + dy * dy), abs(dz)))), 6) AS max_angle FROM d GROUP BY well""")
def deviation_angle(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("well"), "ts", (F.col("event_id") % 13).alias("x"), (F.col("event_id") % 7).alias("y"), F.col("value").alias("z"))
    return rounded(L.largest_slope(rows, ["well"], "ts", "x", "y", "z"))


@query(f"""WITH {SAMPLES}, ranks AS (SELECT well, row_number() OVER (PARTITION BY well ORDER BY vp, ts) - 1 - count(*) OVER (PARTITION BY well) / 2 AS a, row_number() OVER (PARTITION BY well ORDER BY vs, ts) - 1 - count(*) OVER (PARTITION BY well) / 2 AS b FROM samples WHERE vp IS NOT NULL AND vs IS NOT NULL)
SELECT well, count(*) AS n, round(sum(a * b) / sum(a * a), 6) + 0.0 AS rank_correlation, sum(a * b) / sum(a * a) > 0.99 AS synthetic FROM ranks GROUP BY well""")
def rank_correlation(spark, sf_dir):
    return rounded(L.rank_correlation(samples(spark, sf_dir), ["well"], "vp", "vs", "ts"))


@query(f"""WITH {BLOCKS}, m AS (SELECT avg(ln_vp) AS ma, avg(ln_vs) AS mb FROM blocks)
SELECT CAST(lag AS INT) AS lag, count(*) AS n, round(avg((x.ln_vp - ma) * (y.ln_vs - mb)), 8) + 0.0 AS covariance
FROM m, range(0, 6) r(lag), blocks x, blocks y WHERE x.well = y.well AND y.block = x.block + lag AND x.ln_vp IS NOT NULL AND y.ln_vs IS NOT NULL GROUP BY lag""")
def lag_covariance(spark, sf_dir):
    return rounded(L.lag_covariance(L.block_logs(samples(spark, sf_dir), ["well"], "block", ["vp", "vs"]), ["well"], "block", "ln_vp", "ln_vs", 5), 8)


def _angles_sql() -> str:
    one = lambda a: "round({} * ln(1300 + 12 * value) + {} * ln((1300 + 12 * value) / 1.9 + event_id % 50) + {} * ln(1.5 + value / 400), 6)".format(*map(repr, E.reflection_row(a)))
    return f"SELECT event_id, {', '.join(f'{one(a)} AS ei_{a}' for a in (0, 15, 30))} FROM events"


@query(_angles_sql())
def angle_impedance(spark, sf_dir):
    v = 1300 + 12 * F.col("value")
    a, b, r = F.ln(v), F.ln(v / 1.9 + F.col("event_id") % 50), F.ln(1.5 + F.col("value") / 400)
    return rounded(read(spark, sf_dir, "events").select("event_id", *[E.impedance(a, b, r, angle).alias(f"ei_{angle}") for angle in (0, 15, 30)]))


@query("""WITH r AS (SELECT event_id, user_id, ts, coalesce(ln(value) - lag(ln(value)) OVER (PARTITION BY user_id ORDER BY ts), 0) AS c FROM events)
SELECT event_id, round(c, 6) + 0.0 AS reflection, round(-0.25 * coalesce(lead(c) OVER w, 0) + c - 0.25 * coalesce(lag(c) OVER w, 0), 6) + 0.0 AS synthetic FROM r WINDOW w AS (PARTITION BY user_id ORDER BY ts)""")
def synthetic_seismic(spark, sf_dir):
    """Of equal times, which the SQL leaves open, the smaller event_id comes first."""
    order = ["ts", "event_id"]
    rows = L.reflections(read(spark, sf_dir, "events"), ["user_id"], order, E.log(F.col("value")), "reflection")
    return rounded(L.convolve(rows, ["user_id"], order, "reflection", WAVELET, "synthetic").select("event_id", "reflection", "synthetic"))


@query("""SELECT l_linenumber, count(v) AS n, count(*) - count(v) AS n_missing, min(v) AS min, max(v) AS max, round(avg(v), 4) AS mean, round(avg(CASE WHEN v <> 0 THEN v * v END), 2) AS data_variance
FROM (SELECT l_linenumber, CASE WHEN l_orderkey % 5 <> 0 THEN l_extendedprice END AS v FROM lineitem) GROUP BY l_linenumber""")
def grid_statistics(spark, sf_dir):
    cells = read(spark, sf_dir, "lineitem").select("l_linenumber", F.when(F.col("l_orderkey") % 5 != 0, F.col("l_extendedprice")).alias("v"))
    return G.statistics(cells, "v", ["l_linenumber"]).withColumn("mean", F.round("mean", 4)).withColumn("data_variance", F.round("data_variance", 2))


@query("""WITH p AS (SELECT o_custkey % 1000 AS x, o_orderkey % 500 AS y, o_totalprice AS z FROM orders)
SELECT least(x // 50, 18) AS i, least(y // 25, 19) AS j, least(CAST(floor(8 * (z - 1000) / 399000) AS BIGINT), 7) AS k, count(*) AS n, round(avg(z), 4) AS mean_z
FROM p WHERE x <= 950 AND z > 1000 AND z < 400000 GROUP BY ALL""")
def point_to_cell(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 1000).alias("x"), (F.col("o_orderkey") % 500).alias("y"), F.col("o_totalprice").alias("z"))
    cell = G.cell_index(F.col("x"), F.col("y"), F.col("z"), F.lit(1000.0), F.lit(400000.0), 0, 0, 50, 25, 19, 20, 8)
    return rows.withColumn("c", cell).where("c IS NOT NULL").groupBy("c.i", "c.j", "c.k").agg(F.count("*").alias("n"), F.round(F.avg("z"), 4).alias("mean_z"))


@query("""SELECT r_regionkey AS zone, count(*) AS n, round(avg(o_totalprice), 4) AS mean_z
FROM orders LEFT JOIN region ON o_totalprice >= r_regionkey * 90000 AND o_totalprice < r_regionkey * 90000 + 80000 GROUP BY r_regionkey""")
def zone_lookup(spark, sf_dir):
    top = (F.col("r_regionkey") * 90000).cast("double")
    zones = read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("zone"), top.alias("top"), (top + 80000).alias("base"))
    return G.zone_of(read(spark, sf_dir, "orders"), zones, "o_totalprice").groupBy("zone").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean_z"))


@query("""WITH s AS (SELECT n_regionkey AS place, n_nationkey AS n, n_nationkey * 7 % 25 AS p, CAST(n_nationkey * 37 % 101 AS DOUBLE) AS z FROM nation),
b AS (SELECT a.place, a.n, any_value(a.z) AS z, max(CASE WHEN o.n < a.n AND o.p < a.p THEN o.z END) AS lo, min(CASE WHEN o.n > a.n AND o.p < a.p THEN o.z END) AS hi FROM s a JOIN s o USING (place) GROUP BY a.place, a.n)
SELECT place, n, z, least(greatest(z, coalesce(lo, z)), coalesce(hi, greatest(z, coalesce(lo, z)))) AS z_eroded FROM b""")
def eroded_surfaces(spark, sf_dir):
    key = F.col("n_nationkey")
    rows = read(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("place"), key.alias("n"), (key * 7 % 25).alias("p"), (key * 37 % 101).cast("double").alias("z"))
    return G.eroded(rows, ["place"], "n", "p", "z").select("place", "n", "z", "z_eroded")


@query("""WITH v AS (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS v FROM events) SELECT event_id, round(coalesce(v, (SELECT avg(v) FROM v)), 6) AS filled FROM v""")
def missing_to_mean(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"))
    return rounded(G.missing_to_mean(rows, "v", "filled").select("event_id", "filled"))


@query("""WITH c AS (SELECT event_id, greatest(coalesce(CASE WHEN event_id % 7 <> 0 THEN value END, 0), 0) AS a, greatest(200 - value, 0) AS b, greatest(value - 100, 0) AS c FROM events)
SELECT event_id, round(a / nullif(a + b + c, 0), 6) AS p1, round(b / nullif(a + b + c, 0), 6) AS p2, round(c / nullif(a + b + c, 0), 6) AS p3 FROM c""")
def normalised_priors(spark, sf_dir):
    v = F.col("value")
    each = G.normalised_priors([F.when(F.col("event_id") % 7 != 0, v), 200 - v, v - 100])
    return rounded(read(spark, sf_dir, "events").select("event_id", *[p.alias(f"p{k + 1}") for k, p in enumerate(each)]))


@query("""SELECT count(*) AS n, round(max(abs(a - b)), 4) AS max_abs_diff, round(avg(abs(a - b)), 4) AS mean_abs_diff, round(avg(a - b), 4) AS mean_diff, round(avg(a), 4) AS mean_value
FROM (SELECT abs(p_retailprice) AS a, abs(p_size * 30.0 - 600) AS b FROM part)""")
def grid_comparison(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    a, b = part.select("p_partkey", F.col("p_retailprice").alias("v")), part.select("p_partkey", (F.col("p_size") * F.lit(30.0) - 600).alias("v"))
    return rounded(G.compared(a, b, ["p_partkey"], "v"), 4)


@query("""WITH s AS (SELECT i % 7 AS i, i // 7 AS j, CAST(i * i % 31 AS DOUBLE) AS z FROM range(0, 49) t(i)), p AS (SELECT p_partkey, (p_partkey % 60) / 10.0 AS x, (p_partkey % 59) / 10.0 AS y FROM part),
c AS (SELECT p.*, a, b, (CASE WHEN a = 1 THEN x - floor(x) ELSE 1 - x + floor(x) END) * (CASE WHEN b = 1 THEN y - floor(y) ELSE 1 - y + floor(y) END) AS w FROM p, range(0, 2) q(a), range(0, 2) r(b))
SELECT p_partkey, x, y, round(sum(w * z), 6) + 0.0 AS z FROM c JOIN s ON s.i = floor(x) + a AND s.j = floor(y) + b WHERE w > 0 GROUP BY p_partkey, x, y""")
def bilinear_lookup(spark, sf_dir):
    surface = spark.range(49).select((F.col("id") % 7).alias("i"), F.floor(F.col("id") / 7).alias("j"), (F.col("id") * F.col("id") % 31).cast("double").alias("z"))
    points = read(spark, sf_dir, "part").select("p_partkey", ((F.col("p_partkey") % 60) / 10).alias("x"), ((F.col("p_partkey") % 59) / 10).alias("y"))
    return rounded(G.bilinear(surface, points, 0, 0, 1, 1))


FACIES = "f AS (SELECT label AS facies, CAST(embedding[1] AS DOUBLE) AS v FROM embeddings)"


def facies_samples(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select(F.col("label").alias("facies"), F.col("embedding")[0].cast("double").alias("v"))


@query(f"WITH {FACIES} SELECT facies, count(*) AS n, round(count(*) / (SELECT count(*) FROM f), 6) AS prior FROM f GROUP BY facies")
def facies_prior(spark, sf_dir):
    return rounded(P.prior_probability(facies_samples(spark, sf_dir), "facies"))


@query(f"""WITH {FACIES}, b AS (SELECT facies, CAST(floor((v + 3) / 6 * 12) AS BIGINT) + 1 AS bin FROM f WHERE v >= -3 AND v < 3), h AS (SELECT facies, bin, count(*) AS n FROM b GROUP BY ALL),
d AS (SELECT *, n / sum(n) OVER (PARTITION BY facies) * 2.0 AS density FROM h), p AS (SELECT facies, count(*) / (SELECT count(*) FROM f) AS prior FROM f GROUP BY facies),
w AS (SELECT bin, facies, prior * density AS w FROM d JOIN p USING (facies))
SELECT bin, facies, round(w / (sum(w) OVER (PARTITION BY bin) + 0.01 / 6), 6) AS probability, round(0.01 / 6 / (sum(w) OVER (PARTITION BY bin) + 0.01 / 6), 6) AS undefined FROM w""")
def facies_posterior(spark, sf_dir):
    rows = facies_samples(spark, sf_dir)
    return rounded(P.posterior(P.histogram(rows, "facies", F.col("v"), -3.0, 3.0, 12), P.prior_probability(rows, "facies"), "facies", 0.01, 6.0))


@query(f"WITH {FACIES} SELECT facies, count(*) AS n, round(avg(exp(-v * v)), 6) AS p1, round(avg(1 - exp(-v * v)), 6) AS p2 FROM f GROUP BY facies")
def conditional_facies(spark, sf_dir):
    rows = facies_samples(spark, sf_dir).withColumn("a", F.exp(-F.col("v") * F.col("v"))).withColumn("b", 1 - F.col("a"))
    return rounded(P.conditional_table(rows, "facies", {"p1": "a", "p2": "b"}))


@query("""SELECT p_partkey, round(CASE WHEN p_size / 40.0 < 1 THEN 1 - 1.5 * (p_size / 40.0) + 0.5 * (p_size / 40.0) ^ 3 ELSE 0 END, 6) + 0.0 AS spherical, round(exp(-3 * (p_size / 40.0) ^ 1.5), 6) AS general_exponential,
round(sqrt(((p_size * cos(0.5) + p_partkey % 17 * sin(0.5)) / 40.0) ^ 2 + ((p_partkey % 17 * cos(0.5) - p_size * sin(0.5)) / 20.0) ^ 2), 6) AS distance,
round((1 - 2 * (pi() * 30 * p_size / 1000.0) ^ 2) * exp(0 - (pi() * 30 * p_size / 1000.0) ^ 2), 6) + 0.0 AS ricker FROM part""")
def variograms(spark, sf_dir):
    size, other = F.col("p_size").cast("double"), (F.col("p_partkey") % 17).cast("double")
    h = size / 40
    return rounded(read(spark, sf_dir, "part").select("p_partkey", E.spherical(h).alias("spherical"), E.general_exponential(h, 1.5).alias("general_exponential"), E.anisotropic_distance(size, other, 40.0, 20.0, 0.5).alias("distance"), E.ricker(size / 1000, 30.0).alias("ricker")))


@query("""WITH o AS (SELECT o_custkey % 100 AS cell, (o_totalprice - 200000) / 1000 AS v, 50.0 + o_orderkey % 10 AS s FROM orders)
SELECT cell, count(*) AS n, round((0 + sum(v / s)) / (1 / 100.0 + sum(1 / s)), 5) + 0.0 AS mean, round(1 / (1 / 100.0 + sum(1 / s)), 6) AS variance FROM o GROUP BY cell""")
def time_lapse_state(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).alias("cell"), ((F.col("o_totalprice") - 200000) / 1000).alias("v"), (F.lit(50.0) + F.col("o_orderkey") % 10).alias("s"))
    out = updated_state(rows, ["cell"], "v", "s", 0.0, 100.0)
    return rounded(out.withColumn("mean", F.round("mean", 5)))


@query("""SELECT o_orderpriority AS survey, count(*) AS n, round(avg(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) / 365.24), 6) AS mean_years, round(max(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) / 365.24), 6) AS last_year FROM orders GROUP BY o_orderpriority""")
def timeline(spark, sf_dir):
    years = E.years_between(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date"))
    return rounded(read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("survey")).agg(F.count("*").alias("n"), F.avg(years).alias("mean_years"), F.max(years).alias("last_year")))


@query("""WITH RECURSIVE e AS (SELECT user_id AS well, value, epoch_us(ts) / 3.6e9 AS h FROM events),
starts AS (SELECT well, min(h) AS s, 0 AS g FROM e GROUP BY well UNION ALL SELECT s.well, min(e.h) AS s, s.g + 1 AS g FROM starts s JOIN e ON e.well = s.well AND e.h >= s.s + 6 GROUP BY s.well, s.g),
spans AS (SELECT well, g, s, lead(s) OVER (PARTITION BY well ORDER BY g) AS e FROM starts)
SELECT e.well, CAST(g AS BIGINT) AS "group", count(*) AS n, round(avg(h), 6) AS hours, round(avg(value), 6) AS value FROM e JOIN spans x ON e.well = x.well AND e.h >= x.s AND (x.e IS NULL OR e.h < x.e) GROUP BY e.well, g""")
def merged_samples(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("well"), "value", (F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9).alias("hours"))
    return rounded(L.merge_near_duplicates(rows, ["well"], "hours", ["value"], 6.0))


@query()
def kriged_layers(spark, sf_dir):
    """Every day's wells, kriged onto all places that wells have."""
    data = blocks(spark, sf_dir).select("block", (F.col("well") % 10).cast("double").alias("x"), F.floor(F.col("well") / 10).cast("double").alias("y"), F.col("ln_vp").alias("value"))
    last = read(spark, sf_dir, "events").agg(F.max("user_id")).first()[0] // 10
    line = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n)).cast("array<double>"))
    cells = data.select("block").distinct().withColumn("x", line(9)).withColumn("y", line(last))
    return I.krige(data, cells, "block", 5.0, 1.5, 8.2)


@query()
def bayesian_inversion(spark, sf_dir):
    forward = np.array([E.reflection_row(a) for a in (5, 15, 30)])
    prior = np.array([[0.01, 0.006, 0.002], [0.006, 0.012, 0.001], [0.002, 0.001, 0.004]])
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double") * 0.1).alias("data"), F.array(*[F.lit(0.0)] * 3).alias("prior_mean"))
    return I.invert(rows, forward, prior, 0.002 * np.eye(3), "prior_mean", "data")
