"""Queries of fluids, rock samples with trends and the errors of angle stacks, over the driver's tables, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataspark.functions import fluids
from strataspark.functions.rock import trend_value
from strataspark.operators import rock_samples as R

from .reference_queries import ORACLES, QUERIES, query, read, rounded

__all__ = ["ORACLES", "QUERIES"]


@query("""WITH b AS (SELECT p_partkey, 10 + 2e0 * p_size AS t, p_retailprice / 50 AS p, (p_partkey % 25) / 100e0 AS s FROM part),
w AS (SELECT *, 1 + 1e-6 * (-80 * t - 3.3 * t ** 2 + 0.00175 * t ** 3 + 489 * p - 2 * t * p + 0.016 * t ** 2 * p - 1.3e-5 * t ** 3 * p - 0.333 * p ** 2 - 0.002 * t * p ** 2) AS rw,
  1402.85 + 1.524 * p + 3.437e-3 * p ** 2 - 1.197e-5 * p ** 3 + t * (4.871 - 0.0111 * p + 1.739e-4 * p ** 2 - 1.628e-6 * p ** 3) + t ** 2 * (-0.04783 + 2.747e-4 * p - 2.135e-6 * p ** 2 + 1.237e-8 * p ** 3)
  + t ** 3 * (1.487e-4 - 6.503e-7 * p - 1.455e-8 * p ** 2 + 1.327e-10 * p ** 3) + t ** 4 * (-2.197e-7 + 7.987e-10 * p + 5.230e-11 * p ** 2 - 4.614e-13 * p ** 3) AS vw FROM b),
r AS (SELECT *, rw + s * (0.668 + 0.44 * s + 1e-6 * (300 * p - 2400 * p * s + t * (80 + 3 * t - 3300 * s - 13 * p + 47 * p * s))) AS rho,
  vw + s * (1170 - 9.6 * t + 0.055 * t ** 2 - 8.5e-5 * t ** 3 + 2.6 * p - 0.0029 * t * p - 0.0476 * p ** 2) + s ** 1.5 * (780 - 10 * p + 0.16 * p ** 2) - 820 * s ** 2 AS v FROM w)
SELECT p_partkey, round(rho, 8) AS density, round(v, 5) AS velocity, round(rho * v * v / 1e6, 8) AS modulus FROM r""")
def brine(spark, sf_dir):
    t, p, s = 10 + 2.0 * F.col("p_size"), F.col("p_retailprice") / 50, (F.col("p_partkey") % 25) / 100.0
    return read(spark, sf_dir, "part").select("p_partkey", F.round(fluids.brine_density(t, p, s), 8).alias("density"), F.round(fluids.brine_velocity(t, p, s), 5).alias("velocity"), F.round(fluids.brine_modulus(t, p, s) / 1e6, 8).alias("modulus"))


CORRELATION = [[1.0, 0.8, 0.5], [0.8, 1.0, 0.28], [0.5, 0.28, 1.0]]
# The Cholesky factor of CORRELATION: 1; 0.8, 0.6; 0.5, -0.2, sqrt(0.71).
SAMPLES = """u AS (SELECT l_linenumber % 5 AS node, ((l_partkey * 7 + l_suppkey) % 997 + 0.5) / 997 AS a, (l_orderkey % 991 + 0.5) / 991 AS b, ((l_orderkey * 3 + l_partkey) % 983 + 0.5) / 983 AS c, (l_suppkey % 89 + 0.5) / 89 AS d FROM lineitem),
z AS (SELECT node, sqrt(-2 * ln(a)) * cos(2 * pi() * b) AS x, sqrt(-2 * ln(a)) * sin(2 * pi() * b) AS y, sqrt(-2 * ln(c)) * cos(2 * pi() * d) AS w FROM u),
rocks AS (SELECT node, 2500 + 125 * node + x * sqrt(10000 + 1000 * node) AS vp, 1200 + 50 * node + (0.8 * x + 0.6 * y) * 80 AS vs, 2.2 + (0.5 * x - 0.2 * y + sqrt(0.71) * w) * 0.05 AS rho FROM z),
tables AS (SELECT node, count(*) AS n, count(*) FILTER (vp <= 0 OR vs <= 0 OR rho <= 0) AS n_bad, avg(ln(vp)) AS mean_vp, avg(ln(vs)) AS mean_vs, avg(ln(rho)) AS mean_rho,
  covar_samp(ln(vp), ln(vp)) AS cov_vp_vp, covar_samp(ln(vp), ln(vs)) AS cov_vp_vs, covar_samp(ln(vp), ln(rho)) AS cov_vp_rho, covar_samp(ln(vs), ln(vs)) AS cov_vs_vs, covar_samp(ln(vs), ln(rho)) AS cov_vs_rho, covar_samp(ln(rho), ln(rho)) AS cov_rho_rho FROM rocks GROUP BY node)"""
ROUNDED = ", ".join(f"{{f}}(round({{g}}({c}), 8)) + 0.0 AS {c}" for c in ("mean_vp", "mean_vs", "mean_rho", "cov_vp_vp", "cov_vp_vs", "cov_vp_rho", "cov_vs_vs", "cov_vs_rho", "cov_rho_rho"))


def _tables(spark, sf_dir):
    """Rocks whose vp and vs have trends in a node, drawn by uniform numbers of the table's keys."""
    part, order, supp = F.col("l_partkey"), F.col("l_orderkey"), F.col("l_suppkey")
    u = [((part * 7 + supp) % 997 + 0.5) / 997, (order % 991 + 0.5) / 991, ((order * 3 + part) % 983 + 0.5) / 983, (supp % 89 + 0.5) / 89]
    node = F.col("l_linenumber") % 5
    x, y, w = R.correlated(R.normals(u)[:3], CORRELATION)
    trend = lambda first, last: trend_value(node, 0.0, 2.0, [first, (first + last) / 2, last])
    rocks = read(spark, sf_dir, "lineitem").select(node.alias("node"), R.normal_with_trend(x, trend(2500.0, 3000.0), trend(10000.0, 14000.0)).alias("vp"), R.normal_with_trend(y, trend(1200.0, 1400.0), F.lit(6400.0)).alias("vs"), R.normal_with_trend(w, F.lit(2.2), F.lit(0.0025)).alias("rho"))
    return R.rock_tables(rocks, ["node"])


@query(f"WITH {SAMPLES} SELECT node, n, n_bad, {ROUNDED.format(f='', g='')} FROM tables")
def rock_tables(spark, sf_dir):
    return rounded(_tables(spark, sf_dir), 8)


@query(f"WITH {SAMPLES} SELECT count(*) AS n_nodes, {ROUNDED.format(f='', g='avg')} FROM tables")
def mean_rock_table(spark, sf_dir):
    return rounded(R.mean_table(_tables(spark, sf_dir), ["node"]), 8)


@query("""WITH v AS (SELECT 10 * l_linenumber AS a, avg(l_tax * l_tax) FILTER (l_tax <> 0) AS v FROM lineitem GROUP BY ALL),
s AS (SELECT 10 * l_linenumber AS a, min(1 + l_discount) AS m FROM lineitem WHERE l_linenumber <> 2 GROUP BY ALL), e AS (SELECT v.a, sqrt(v * coalesce(m, 1) / (2 + v.a / 10)) AS e FROM v LEFT JOIN s USING (a))
SELECT CAST(x.a AS INT) AS p, CAST(y.a AS INT) AS q, round(x.e * y.e * exp(-3 * abs(x.a - y.a) / 30.0), 10) AS covariance FROM e x, e y""")
def error_covariance(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").withColumn("angle", (10 * F.col("l_linenumber")).cast("int"))
    ratios = rows.select("angle").distinct().withColumn("ratio", 2 + F.col("angle") / 10)
    scales = rows.where("l_linenumber <> 2").select("angle", (1 + F.col("l_discount")).alias("scale"))
    return rounded(R.error_covariance(rows, "angle", "l_tax", ratios, lambda d: F.exp(-3 * F.abs(d) / 30.0), scales), 10)
