"""Samples of rocks with trends: reproducible numbers by place, Gaussian copula, expectations and covariances over a mesh of trend values.

A number is a hash of its seed and keys, so that a task that runs twice, wherever, draws the same, and no partitioning matters."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The parts of a rock whose logarithms are tabulated.
PARTS = ("vp", "vs", "rho")


def uniform(seed: int, *keys: Column) -> Column:
    """A number in (0, 1) for each value of the keys: the upper 53 bits of their hash, in the middle of their cell."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) + 0.5) / float(1 << 53)


def normals(u: list[Column]) -> list[Column]:
    """Independent standard normal numbers of as many independent uniform ones, an even number, in pairs (Box and Muller, 1958)."""
    out = []
    for a, b in zip(u[::2], u[1::2], strict=True):
        radius = F.sqrt(-2 * F.ln(a))
        out += [radius * F.cos(2 * math.pi * b), radius * F.sin(2 * math.pi * b)]
    return out


def correlated(z: list[Column], correlation: list[list[float]]) -> list[Column]:
    """Standard normal numbers with the given correlations, of independent ones: a Gaussian copula. The matrix must be positive definite."""
    r = np.asarray(correlation, float)
    if r.shape != (len(z), len(z)) or not np.allclose(r, r.T) or not np.allclose(np.diag(r), 1):
        raise ValueError("correlations are a symmetric matrix with ones on its diagonal")
    low = np.linalg.cholesky(r)
    out = []
    for k in range(len(z)):
        total = float(low[k, 0]) * z[0]
        for m in range(1, k + 1):
            total = total + float(low[k, m]) * z[m]
        out.append(total)
    return out


def normal_with_trend(z: Column, mean: Column, variance: Column) -> Column:
    """A normal number whose mean and variance are trends at the place (see `rock.trend_value`); null for a negative variance."""
    return mean + z * F.when(variance >= 0, F.sqrt(variance))


def rock_tables(samples: DataFrame, mesh: list[str]) -> DataFrame:
    """(mesh, n, n_bad, mean_<a>, cov_<a>_<b>): means and covariances of ln vp, ln vs, ln rho of the samples at each mesh node.

    A node with a sample that has a part of 0 or less, or none (`n_bad`), gets nulls: its variances may be too large. Covariances divide by n - 1."""
    whole = [F.coalesce(F.col(c) > 0, F.lit(False)) for c in PARTS]
    bad = ~(whole[0] & whole[1] & whole[2])
    logs = {c: F.ln(F.when(F.col(c) > 0, F.col(c))) for c in PARTS}
    pairs = [(a, b) for k, a in enumerate(PARTS) for b in PARTS[k:]]
    found = samples.groupBy(*mesh).agg(F.count("*").alias("n"), F.count_if(bad).alias("n_bad"), *[F.avg(logs[c]).alias(f"mean_{c}") for c in PARTS], *[F.covar_samp(logs[a], logs[b]).alias(f"cov_{a}_{b}") for a, b in pairs])
    return found.select(*mesh, "n", "n_bad", *[F.when(F.col("n_bad") == 0, F.col(c)).alias(c) for c in found.columns[len(mesh) + 2 :]])


def mean_table(tables: DataFrame, mesh: list[str]) -> DataFrame:
    """The means over all mesh nodes, each once; null if a node has nulls, as no rock model holds then."""
    names = [c for c in tables.columns if c not in (*mesh, "n", "n_bad")]
    failed = F.count_if(F.col("n_bad") > 0) > 0
    return tables.agg(F.count("*").alias("n_nodes"), *[F.when(~failed, F.avg(c)).alias(c) for c in names])


def error_covariance(values: DataFrame, angle: str, value: str, ratios: DataFrame, correlation, scales: DataFrame | None = None) -> DataFrame:
    """(p, q, covariance) of the errors of angle stacks, for all pairs of angles (a few).

    An angle's error variance is the mean square of its values that aren't 0 over its signal-to-noise ratio (angle, ratio),
    times its least local noise scale (angle, scale) where `scales` is given; two angles have the correlation
    `correlation(difference)`, a Column. An angle without a ratio or values has no row; one without scales keeps 1."""
    v = F.col(value).cast("double")
    variance = values.groupBy(angle).agg(F.avg(F.when(v != 0, v * v)).alias("_v"))
    rows = variance.join(ratios.select(angle, F.col("ratio").alias("_r")), angle)
    if scales is None:
        rows = rows.withColumn("_m", F.lit(1.0))
    else:
        rows = rows.join(scales.groupBy(angle).agg(F.min("scale").alias("_l")), angle, "left").withColumn("_m", F.coalesce("_l", F.lit(1.0)))
    each = rows.select(F.col(angle).alias("a"), F.sqrt(F.col("_v") * F.col("_m") / F.col("_r")).alias("e")).where("e IS NOT NULL")
    # A survey has a handful of angles: they stand in one array, and each pairs with all.
    all_ = each.agg(F.array_sort(F.collect_list(F.struct("a", "e"))).alias("_all"))
    rows = all_.select(F.explode("_all").alias("p"), "_all").select("p", F.explode("_all").alias("q"))
    return rows.select(F.col("p.a").alias("p"), F.col("q.a").alias("q"), (F.col("p.e") * F.col("q.e") * correlation(F.col("p.a") - F.col("q.a"))).alias("covariance"))
