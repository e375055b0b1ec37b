"""Queries of the operators on intervals, traces and rocks, over the driver's tables, with DuckDB SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from strataspark.functions import rock as R
from strataspark.operators import traces as S
from strataspark.operators import zones as Z

from .reference_queries import ORACLES, QUERIES, SAMPLES, query, read, rounded, samples

__all__ = ["ORACLES", "QUERIES"]
TREND = [10.0, 40.0, 20.0, 80.0]


@query("""WITH p AS (SELECT l_partkey % 500 AS cell, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS part, max(l_quantity) AS v FROM lineitem GROUP BY ALL)
SELECT cell, arg_min(v, part) AS v, CAST(min(part) AS INT) AS part, count(*) AS n_parts FROM p GROUP BY cell""")
def combined_intervals(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 500).alias("cell"), "l_returnflag").agg(F.max("l_quantity").alias("v"))
    return Z.combined([rows.where(F.col("l_returnflag") == f) for f in "ANR"], ["cell"], "v")


@query("""WITH e AS (SELECT o_orderstatus, min(o_custkey) AS a, max(o_custkey) AS b, min(o_totalprice) AS c, max(o_totalprice) AS d FROM orders GROUP BY o_orderstatus)
SELECT max(a) AS x0, min(b) AS x1, max(c) AS y0, min(d) AS y1, max(a) > min(b) OR max(c) > min(d) AS empty FROM e""")
def shared_area(spark, sf_dir):
    return Z.shared_area(read(spark, sf_dir, "orders"), "o_orderstatus", "o_custkey", "o_totalprice")


@query("""SELECT coalesce(a.s, b.s) AS p_size, a.s IS NOT NULL AS in_a, b.s IS NOT NULL AS in_b
FROM (SELECT DISTINCT p_size AS s FROM part WHERE p_size < 30) a FULL JOIN (SELECT DISTINCT p_size AS s FROM part WHERE p_size > 20) b ON a.s = b.s""")
def facies_names(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    return Z.names_compared(part.where("p_size < 30"), part.where("p_size > 20"), "p_size")


@query("""WITH t AS (SELECT p_retailprice / 10 + p_size AS t FROM part), m AS (SELECT max(t) AS m FROM t)
SELECT round(min(t), 6) AS min_thickness, round(max(t) / 40, 6) AS dz, round(avg(t / m), 6) AS mean_relative, count(*) FILTER (t / m < 0.61) AS n_thin FROM t, m""")
def thickness(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select(F.lit(0.0).alias("top"), (F.col("p_retailprice") / 10 + F.col("p_size")).alias("base"))
    return rounded(Z.thickness(rows, "top", "base", 40, 0.61))


@query("""SELECT p_partkey, round(100 + 8e-1 * (p_partkey % 40 + 0.5) * 25 - 6e-1 * (p_size + 0.5) * 12.5, 6) AS x, round(200 + 6e-1 * (p_partkey % 40 + 0.5) * 25 + 8e-1 * (p_size + 0.5) * 12.5, 6) AS y,
round(1000 + (p_partkey % 8 + 0.5) * p_retailprice / 8, 6) AS z FROM part""")
def cell_centre(spark, sf_dir):
    at = Z.cell_centre(F.col("p_partkey") % 40, F.col("p_size"), F.col("p_partkey") % 8, F.lit(1000.0), F.col("p_retailprice") + 1000, 100, 200, 25, 12.5, 8, 0.8, 0.6)
    return rounded(read(spark, sf_dir, "part").select("p_partkey", at.alias("c")).select("p_partkey", "c.x", "c.y", "c.z"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round(sum((1500 + l_quantity * 20) * 4.0 / 2000) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING), 5) AS depth FROM lineitem""")
def depth_conversion(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").withColumn("v", 1500 + F.col("l_quantity") * 20).withColumn("dt", F.lit(4.0))
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    return rounded(Z.depths(rows, ["l_orderkey"], order, "v", "dt").select("l_orderkey", "l_linenumber", "l_partkey", "depth"), 5)


@query("""SELECT count(*) AS n, count(*) FILTER (p_size > p_retailprice / 40 - 5 OR p_retailprice / 20 < p_retailprice / 25 + 15) AS n_short, round(min(p_retailprice / 40 - 5), 6) AS from_z, round(max(p_retailprice / 25 + 15), 6) AS to_z FROM part""")
def data_coverage(spark, sf_dir):
    p = F.col("p_retailprice")
    rows = read(spark, sf_dir, "part").select(F.col("p_size").alias("first"), (p / 20).alias("last"), (p / 40).alias("top"), (p / 25 + 10).alias("base"))
    return rounded(Z.coverage(rows, "first", "last", "top", "base", 5.0))


@query("SELECT DISTINCT user_id FROM events WHERE value BETWEEN 250 AND 480 AND hour(ts) BETWEEN 6 AND 17")
def wells_inside(spark, sf_dir):
    return Z.wells_inside(read(spark, sf_dir, "events"), "user_id", F.col("value").between(250, 480) & F.hour("ts").between(6, 17))


@query("""SELECT n_nationkey, round(sum(500 * p_retailprice / ((p_partkey % 50 - n_nationkey * 2) ** 2 + (p_size - n_regionkey * 10) ** 2 + 10000.0)), 4) AS response FROM part, nation GROUP BY n_nationkey""")
def gravity_response(spark, sf_dir):
    sites = read(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") * 2).alias("x"), (F.col("n_regionkey") * 10).alias("y"), F.lit(-100.0).alias("z"))
    cells = read(spark, sf_dir, "part").select((F.col("p_partkey") % 50).alias("x"), F.col("p_size").alias("y"), F.lit(0.0).alias("z"), F.col("p_retailprice").alias("w"))
    return rounded(Z.gravity(sites, cells, "n_nationkey", "w"), 4)


@query(f"""WITH {SAMPLES}, s AS (SELECT facies, ln(vp) AS a, ln(vs) AS b FROM samples WHERE vp IS NOT NULL), e AS (SELECT count(*) AS n, avg(a) AS a, avg(b) AS b, covar_pop(a, b) AS c FROM s GROUP BY facies),
t AS (SELECT sum(n) AS tn, sum(n * a) / sum(n) AS ta, sum(n * b) / sum(n) AS tb FROM e)
SELECT round(any_value(ta), 6) AS mean_a, round(any_value(tb), 6) AS mean_b, round(sum(n / tn * c), 6) AS within, round(sum(n / tn * (a - ta) * (b - tb)), 6) + 0.0 AS "between" FROM e, t""")
def facies_mixture(spark, sf_dir):
    rows = samples(spark, sf_dir).select("facies", F.ln("vp").alias("a"), F.ln("vs").alias("b"))
    return rounded(Z.mixture(rows, "facies", "a", "b"))


@query("""WITH r AS (SELECT user_id, value, event_id * 0.25 + event_id % 3 * 0.0625 AS z FROM events), w AS (SELECT *, min(z) OVER u AS z0, max(z) OVER u AS z1, count(*) OVER u AS n FROM r WINDOW u AS (PARTITION BY user_id)),
b AS (SELECT *, CAST(coalesce(floor((z - z0) * (n - 1) / nullif(z1 - z0, 0) + 0.5), 0) AS BIGINT) AS k FROM w),
m AS (SELECT user_id, k, CASE WHEN k = 0 THEN arg_min(value, z) WHEN k = max(n) - 1 THEN arg_max(value, z) ELSE avg(value) END AS value FROM b GROUP BY user_id, k)
SELECT p.user_id, p.k, round(m.value, 6) AS value FROM (SELECT user_id, CAST(unnest(range(0, count(*))) AS BIGINT) AS k FROM events GROUP BY user_id) p LEFT JOIN m ON p.user_id = m.user_id AND p.k = m.k""")
def resampled_log(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("user_id", "value", (F.col("event_id") * 0.25 + F.col("event_id") % 3 * 0.0625).alias("z"))
    return rounded(S.resampled(rows, ["user_id"], "z", "value"))


@query(f"""WITH {SAMPLES} SELECT event_id, coalesce(last_value(vp IGNORE NULLS) OVER (PARTITION BY well ORDER BY ts ROWS UNBOUNDED PRECEDING), first_value(vp IGNORE NULLS) OVER (PARTITION BY well ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS vp_held FROM samples""")
def extrapolated_log(spark, sf_dir):
    return S.extrapolated(samples(spark, sf_dir), ["well"], "ts", "vp", "vp_held").select("event_id", "vp_held")


@query(f"""WITH {SAMPLES}, p AS (SELECT *, row_number() OVER (PARTITION BY well ORDER BY ts) AS at FROM samples)
SELECT a.event_id, round(sum(b.vp * exp(-0.5 * ((a.at - b.at) / 1.5) ** 2)) / sum(CASE WHEN b.vp IS NOT NULL THEN exp(-0.5 * ((a.at - b.at) / 1.5) ** 2) END), 5) AS vp_smooth
FROM p a JOIN p b ON a.well = b.well AND b.at BETWEEN a.at - 4 AND a.at + 4 GROUP BY a.event_id""")
def smoothed_log(spark, sf_dir):
    return rounded(S.smoothed(samples(spark, sf_dir), ["well"], "ts", "vp", "vp_smooth", 1.5, 4).select("event_id", "vp_smooth"), 5)


@query("""WITH w AS (SELECT event_id, lag(value) OVER u AS a, value AS b, lead(value) OVER u AS c FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts))
SELECT event_id, round((a - c) / (2 * (a - 2 * b + c)), 5) + 0.0 AS shift, round(b - (a - c) * ((a - c) / (2 * (a - 2 * b + c))) / 4, 5) AS peak FROM w WHERE (b >= a AND b > c) OR (b <= a AND b < c)""")
def trace_peaks(spark, sf_dir):
    return rounded(S.peaks(read(spark, sf_dir, "events"), ["user_id"], "ts", "value").select("event_id", "shift", "peak"), 5)


@query("""WITH s AS (SELECT o_custkey % 200 AS well, sum((o_orderkey % 100) ** 2) AS ss, sum(o_orderkey % 100 * (o_totalprice / 4000)) AS sd, sum((o_totalprice / 4000) ** 2) AS dd FROM orders GROUP BY ALL),
e AS (SELECT well, exp(ln(5) * (2 * k / 94.0 - 1)) AS scale, ss, sd, dd FROM s, range(0, 95) r(k))
SELECT well, round(arg_min(scale, scale * scale * ss - 2 * scale * sd + dd), 6) AS scale, round(min(scale * scale * ss - 2 * scale * sd + dd), 4) AS misfit FROM e GROUP BY well""")
def wavelet_scale(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 200).alias("well"), (F.col("o_orderkey") % 100).cast("double").alias("s"), (F.col("o_totalprice") / 4000).alias("d"))
    out = S.best_scale(rows, ["well"], "s", "d")
    return out.select("well", F.round("scale", 6).alias("scale"), F.round("misfit", 4).alias("misfit"))


@query("""WITH p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k, value - 245 AS a, (event_id % 41 - 20) * 1.0 AS b FROM events),
s AS (SELECT x.user_id, y.k - x.k AS shift, sum(x.a * y.b) AS score FROM p x JOIN p y ON x.user_id = y.user_id AND y.k BETWEEN x.k - 3 AND x.k + 3 GROUP BY ALL)
SELECT user_id, CAST(shift AS INT) AS shift, round(score, 4) AS score FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(score, 6) DESC, abs(shift), shift) = 1""")
def well_shift(spark, sf_dir):
    from pyspark.sql.window import Window

    rows = read(spark, sf_dir, "events").select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts")).alias("k"), (F.col("value") - 245).alias("a"), ((F.col("event_id") % 41 - 20) * F.lit(1.0)).alias("b"))
    return rounded(S.best_shift(rows, ["user_id"], "k", "a", "b", 3), 4)


@query("""WITH f AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events) SELECT user_id, event_type, CAST(count(*) FILTER (p IS DISTINCT FROM event_type) AS BIGINT) AS n_runs, count(*) AS n FROM f GROUP BY user_id, event_type""")
def facies_runs(spark, sf_dir):
    return S.class_runs(read(spark, sf_dir, "events"), ["user_id"], "ts", "event_type")


@query("""WITH m AS (SELECT p_partkey, 5 + p_size / 10.0 AS dry, 0.05 + p_partkey % 30 / 100.0 AS phi FROM part)
SELECT p_partkey, round(dry + (1 - dry / 37) ** 2 / (phi / 2.25 + (1 - phi) / 37 - dry / (37.0 * 37.0)), 6) AS saturated, round(1 / (phi / 2.25 + (1 - phi) / 37), 6) AS reuss, round((phi * 2.25 + (1 - phi) * 37 + 1 / (phi / 2.25 + (1 - phi) / 37)) / 2, 6) AS hill,
round(sqrt((dry + 4 / 3.0 * 8) / 2.3), 6) AS vp FROM m""")
def rock_physics(spark, sf_dir):
    dry, phi = 5 + F.col("p_size") / F.lit(10.0), F.lit(0.05) + F.col("p_partkey") % 30 / F.lit(100.0)
    pair, share = [F.lit(2.25), F.lit(37.0)], [phi, 1 - phi]
    vp, _ = R.velocities(dry, F.lit(8.0), F.lit(2.3))
    return rounded(read(spark, sf_dir, "part").select("p_partkey", R.gassmann(dry, F.lit(37.0), F.lit(2.25), phi).alias("saturated"), R.reuss(pair, share).alias("reuss"), R.hill(pair, share).alias("hill"), vp.alias("vp")))


@query("""WITH p AS (SELECT p_partkey, greatest(0.0, least(3.0, (p_size - 10) / 8.0)) AS s, greatest(0.0, least(1.0, (p_size - 25 + 12) / 24.0)) AS t FROM part), q AS (SELECT *, least(floor(s), 2) AS i FROM p)
SELECT p_partkey, round([10.0, 40.0, 20.0, 80.0][CAST(i AS INT) + 1] * (1 - s + i) + [10.0, 40.0, 20.0, 80.0][CAST(i AS INT) + 2] * (s - i), 6) AS trend, round(3 * t * t - 2 * t * t * t, 6) AS above FROM q""")
def trends_and_horizons(spark, sf_dir):
    size = F.col("p_size").cast("double")
    return rounded(read(spark, sf_dir, "part").select("p_partkey", R.trend_value(size, 10.0, 8.0, TREND).alias("trend"), R.horizon_above(size - 25, 12.0).alias("above")))


@query("""SELECT o_orderkey, CAST(365 * (year(o_orderdate) - 1900) + (year(o_orderdate) - 1900) // 4 + CASE WHEN o_orderkey % 5 = 0 THEN 182 ELSE [0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334][month(o_orderdate)] + CASE WHEN o_orderkey % 7 = 0 THEN 15 ELSE day(o_orderdate) END END AS BIGINT) AS survey_day FROM orders""")
def vintage_day(spark, sf_dir):
    month, day = F.when(F.col("o_orderkey") % 5 != 0, F.month("o_orderdate")), F.when(F.col("o_orderkey") % 7 != 0, F.dayofmonth("o_orderdate"))
    return read(spark, sf_dir, "orders").select("o_orderkey", R.survey_day(F.year("o_orderdate"), month, day).alias("survey_day"))


@query(f"""SELECT vec_id, round(list_sum(list_transform(embedding, lambda v, i: CAST(v AS DOUBLE) * CASE WHEN i <= 8 THEN sin((i - 1) * {math.pi / 16!r}) ** 2 WHEN i > 56 THEN cos((i - 56) * {math.pi / 16!r}) ** 2 ELSE 1 END)), 5) + 0.0 AS total FROM embeddings""")
def tapered_traces(spark, sf_dir):
    trace = F.transform("embedding", lambda v: v.cast("double"))
    return rounded(read(spark, sf_dir, "embeddings").select("vec_id", F.aggregate(R.tapered(trace, 8), F.lit(0.0), lambda a, v: a + v).alias("total")), 5)
