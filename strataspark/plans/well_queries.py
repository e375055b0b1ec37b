"""Queries of padding, dry rocks and statistics of wells, over the driver's tables, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataspark.functions import padding as D
from strataspark.functions import rock as R
from strataspark.operators import logs as L
from strataspark.operators import wells as W

from .reference_queries import BLOCKS, ORACLES, QUERIES, SAMPLES, blocks, query, read, rounded, samples

__all__ = ["ORACLES", "QUERIES"]
FACIES = ("click", "error", "purchase", "signup", "view")


@query("""WITH p AS (SELECT p_partkey, p_partkey % 23 AS i, 1 + p_size % 10 AS n, 12 + p_partkey % 7 AS padded FROM part)
SELECT p_partkey, CASE WHEN i < n THEN i WHEN i >= padded THEN NULL WHEN i - n + 1 < padded - i - 1 THEN greatest(n - (i - n + 1), n // 2) ELSE least(padded - i - 1, n // 2) END AS cell,
  round(CASE WHEN i < n THEN 0 WHEN i < padded THEN least(i - n + 1, padded - i) / (least(n, padded - n) / 2.1) END, 6) AS distance FROM p""")
def padding_cells(spark, sf_dir):
    i, n, padded = F.col("p_partkey") % 23, 1 + F.col("p_size") % 10, 12 + F.col("p_partkey") % 7
    return rounded(read(spark, sf_dir, "part").select("p_partkey", D.mirror_index(i, n, padded).alias("cell"), D.boundary_distance(i, n, padded).alias("distance")))


@query("""WITH s AS (SELECT DISTINCT CAST(2 ** a * 3 ** b * 5 ** c * 7 ** d AS BIGINT) AS v FROM range(0, 13) w(a), range(0, 9) x(b), range(0, 6) y(c), range(0, 6) z(d)),
p AS (SELECT p_partkey, p_size * 20 AS n, least(1.0, greatest(0.5 * greatest(abs(p_retailprice * cos(0.5)), abs(300 * sin(0.5))), 25.0) / (p_size * 20 * 25.0)) AS share FROM part)
SELECT p_partkey, round(share, 6) AS share, (SELECT min(v) FROM s WHERE v >= ceil(n * (1 + share))) AS padded FROM p""")
def padding_sizes(spark, sf_dir):
    n = F.col("p_size") * 20
    share = D.padding_share(F.col("p_retailprice") * F.cos(F.lit(0.5)), 300 * F.sin(F.lit(0.5)), F.lit(25.0), n * 25.0)
    return rounded(read(spark, sf_dir, "part").select("p_partkey", share.alias("share"), D.padded_size(n, share, 4096).alias("padded")))


@query(f"""WITH p AS (SELECT p_partkey, 30 + p_size / 10.0 AS k, 20 + p_size / 5.0 AS g, 0.15 + p_size / 80.0 AS phi, 0.01 + p_partkey % 9 / 100.0 AS pr, p_partkey % 5 / 4.0 AS f, {R.COORDINATION} AS t FROM part),
q AS (SELECT *, greatest(0, least(10, (phi - 0.2) / 0.05)) AS place, (1 / g - 1 / (k + g / 3)) / (4 * pi()) AS a, (1 / g + 1 / (k + g / 3)) / (4 * pi()) AS b FROM p),
r AS (SELECT *, least(9, floor(place)) AS low FROM q), c AS (SELECT *, t[CAST(low AS INT) + 1] * (1 - (place - low)) + t[CAST(low AS INT) + 2] * (place - low) AS contacts FROM r),
x AS (SELECT *, (3 * contacts ^ 2 * (1 - phi) ^ 2 * pr / (pi() ^ 4 * b * b)) ^ (1 / 3.0) AS x FROM c)
SELECT p_partkey, round(contacts, 6) AS contacts, round(x / 6, 6) AS bulk, round(f * (3.0 / 5 * x / 6 * (5 * b + a) / (2 * b + a)) + (1 - f) * x / 10, 6) AS shear FROM x""")
def dry_rock(spark, sf_dir):
    size, key = F.col("p_size"), F.col("p_partkey")
    porosity = 0.15 + size / 80
    contacts = R.coordination(porosity)
    bulk, shear = R.walton(30 + size / 10, 20 + size / 5, porosity, 0.01 + key % 9 / 100, key % 5 / 4, contacts)
    return rounded(read(spark, sf_dir, "part").select("p_partkey", contacts.alias("contacts"), bulk.alias("bulk"), shear.alias("shear")))


@query("""WITH p AS (SELECT p_partkey, 3000.0 + p_size AS vp1, 1500.0 + p_size AS vs1, 2.4 AS r1, 2500.0 + p_size AS vp2, 1200.0 AS vs2, 2.2 + p_size / 500.0 AS r2, p_partkey % 5 / 4.0 AS wk, p_partkey % 3 / 2.0 AS wg FROM part),
m AS (SELECT p_partkey, wk * r1 * (vp1 ^ 2 - 4 / 3.0 * vs1 ^ 2) + (1 - wk) * r2 * (vp2 ^ 2 - 4 / 3.0 * vs2 ^ 2) AS k, wg * r1 * vs1 ^ 2 + (1 - wg) * r2 * vs2 ^ 2 AS g, 0.5 * r1 + 0.5 * r2 AS rho FROM p)
SELECT p_partkey, round(sqrt((k + 4 / 3.0 * g) / rho), 4) AS vp, round(sqrt(g / rho), 4) AS vs, round(rho, 6) AS rho FROM m""")
def bounded_rock(spark, sf_dir):
    """A rock between a stiffer and a softer one."""
    size, key = F.col("p_size"), F.col("p_partkey")
    upper, lower = (3000.0 + size, 1500.0 + size, F.lit(2.4)), (2500.0 + size, F.lit(1200.0), 2.2 + size / 500)
    (k1, g1), (k2, g2) = R.moduli(*upper), R.moduli(*lower)
    rho = R.between_bounds(upper[2], lower[2], F.lit(0.5))
    vp, vs = R.velocities(R.between_bounds(k1, k2, key % 5 / 4), R.between_bounds(g1, g2, key % 3 / 2), rho)
    return read(spark, sf_dir, "part").select("p_partkey", F.round(vp, 4).alias("vp"), F.round(vs, 4).alias("vs"), F.round(rho, 6).alias("rho"))


@query(f"WITH {SAMPLES} SELECT well, count(vs / vp) AS n, round(avg(vs / vp), 6) AS mean_ratio, round((SELECT avg(vs / vp) FROM samples), 6) AS overall FROM samples GROUP BY well")
def vs_vp_ratio(spark, sf_dir):
    return rounded(W.mean_ratios(samples(spark, sf_dir), ["well"], "vs", "vp"))


@query(f"""WITH {BLOCKS}, t AS (SELECT block, avg(ln_vp) AS t FROM blocks GROUP BY block)
SELECT well, count(ln_vp) AS n, round(sqrt(coalesce(avg((exp(ln_vp) - exp(t)) ^ 2), 0)), 4) AS deviation FROM blocks JOIN t USING (block) GROUP BY well""")
def trend_deviation(spark, sf_dir):
    rows = blocks(spark, sf_dir)
    return rounded(W.trend_deviation(rows, L.vertical_trend(rows, "block", ["ln_vp"]), ["well"], "block", "ln_vp", "ln_vp"), 4)


@query(f"WITH {SAMPLES} SELECT count(*) AS n, round(var_samp(vp), 4) AS var_vp, round(var_samp(vs), 4) AS var_vs, round(var_samp(rho), 6) AS var_rho FROM samples WHERE facies <> 'view'")
def parameter_variances(spark, sf_dir):
    rows = samples(spark, sf_dir).withColumn("facies", F.when(F.col("facies") != "view", F.col("facies")))
    found = W.parameter_variances(rows, "facies", ["vp", "vs", "rho"])
    return found.select("n", F.round("var_vp", 4).alias("var_vp"), F.round("var_vs", 4).alias("var_vs"), F.round("var_rho", 6).alias("var_rho"))


@query(f"""WITH {BLOCKS}, p AS (SELECT well, block, facies, list_transform([0, 1, 2, 3, 4], lambda i: (1 + (block * 7 + i * 3 + well) % 5) / 15.0) AS p FROM blocks),
m AS (SELECT *, CASE WHEN lag(facies) OVER w = facies THEN 0 ELSE 1 END AS s FROM p WINDOW w AS (PARTITION BY well ORDER BY block)), g AS (SELECT *, sum(s) OVER (PARTITION BY well ORDER BY block) AS run FROM m),
r AS (SELECT well, run, facies, count(*) AS n, sum(p[1]) AS p1, sum(p[2]) AS p2, sum(p[3]) AS p3, sum(p[4]) AS p4, sum(p[5]) AS p5 FROM g GROUP BY well, run, facies),
c AS (SELECT well, count(*) AS n_runs, 0.3 * sum({' + '.join(f"(CASE WHEN facies = '{f}' THEN n ELSE 0 END - p{i + 1}) ^ 2 / p{i + 1}" for i, f in enumerate(FACIES))}) AS chi FROM r GROUP BY well),
t AS (SELECT *, 4 * n_runs AS freedom, list_sum(list_transform(range(0, 2 * n_runs), lambda i: exp(i * ln(chi / 2) - chi / 2 - lgamma(i + 1)))) AS pv FROM c)
SELECT well, n_runs, round(chi, 6) AS chi, freedom, round(pv, 6) AS p_value, CASE WHEN pv >= 0.05 THEN 'good' WHEN pv >= 0.025 THEN 'poor' WHEN pv >= 0.005 THEN 'bad' ELSE 'very bad' END AS fit FROM t""")
def facies_fit(spark, sf_dir):
    share = lambda i: (1 + (F.col("block") * 7 + i * 3 + F.col("well")) % 5) / 15
    return rounded(W.facies_fit(blocks(spark, sf_dir), ["well"], "block", "facies", {f: share(i) for i, f in enumerate(FACIES)}))
