"""Prior model of ln vp, ln vs, ln rho from wells: covariances of the three by lag, made fit for an inversion.

Lags are counted by equi-joins over all wells; what leaves the cluster is a 3 x 3 matrix a lag. Its repair is small
linear algebra on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Eigenvalues below the first share of the largest are raised to the second.
LEAST, RAISED = 0.001, 0.0011


def residuals(blocks: DataFrame, values: list[str], background: list[Column] | None = None) -> DataFrame:
    """`blocks` with each value less its background; without one, less its mean over all blocks (the means come as one row)."""
    if background is None:
        means = blocks.agg(*[F.avg(v).alias(f"_mean{k}") for k, v in enumerate(values)])
        joined = blocks.join(F.broadcast(means), F.lit(True))
        return joined.withColumns({v: F.col(v) - F.col(f"_mean{k}") for k, v in enumerate(values)}).drop(*means.columns)
    return blocks.withColumns({v: F.col(v) - b for v, b in zip(values, background, strict=True)})


def auto_covariances(blocks: DataFrame, keys: list[str], layer: str, values: list[str], lags: int, weight: str | None = None) -> DataFrame:
    """(lag, p, q, n, weight, covariance): residual p of a layer with residual q `lag` layers below it, over all wells.

    `blocks` has one row for each well and layer, with residuals; rows without one of a pair don't count for that pair.
    A well's rows weigh `weight` (1 without), the pair the product. Every block is sent to the lags + 1 layers it meets,
    an equi-join on well and layer; the nine products of a pair are summed in the tasks, so that what is shuffled for
    the sums is a row for each task and lag. A lag that no pair of blocks has is not there."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    of = lambda name: F.array(*[F.col(v).cast("double") for v in values]).alias(name)
    left = blocks.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(lags))).alias("lag"), F.col(layer).alias("_k"), of("_a"), w.alias("_w")).withColumn("_at", F.col("_k") + F.col("lag"))
    right = blocks.select(*keys, F.col(layer).alias("_at"), of("_b"), w.alias("_v"))
    pairs = left.join(right, [*keys, "_at"])
    sums = []
    for p in range(len(values)):
        for q in range(len(values)):
            a, b = F.get("_a", F.lit(p)), F.get("_b", F.lit(q))
            both = a.isNotNull() & b.isNotNull()
            sums.append(F.struct(F.lit(p).alias("p"), F.lit(q).alias("q"), F.count_if(both).alias("n"), F.sum(F.when(both, F.col("_w") * F.col("_v"))).alias("weight"), F.sum(F.when(both, F.col("_w") * F.col("_v") * a * b)).alias("total")))
    found = pairs.groupBy("lag").agg(F.array(*sums).alias("s")).select("lag", F.explode("s").alias("s")).where("s.n > 0")
    return found.select("lag", "s.p", "s.q", "s.n", "s.weight", F.try_divide(F.col("s.total"), F.col("s.weight")).alias("covariance"))


def lag_matrices(found: DataFrame, size: int, lags: int) -> tuple[np.ndarray, int]:
    """((lags + 1, size, size) covariances, how many leading lags have data); later ones are zero. At most (lags + 1) * size ** 2 rows are read."""
    out, has = np.zeros((lags + 1, size, size)), np.zeros((lags + 1, size, size), bool)
    for r in found.where(F.col("lag") <= lags).collect():
        out[r.lag, r.p, r.q], has[r.lag, r.p, r.q] = r.covariance, True
    whole = has.all(axis=(1, 2))
    n = int(np.argmin(whole)) if not whole.all() else lags + 1
    out[n:] = 0
    if n:
        out[0] = (out[0] + out[0].T) / 2
    return out, n


def well_conditioned(cov: np.ndarray) -> np.ndarray:
    """`cov` with its least eigenvalues raised, so that it can be inverted."""
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    top = values.max()
    return (vectors * np.where(values < top * LEAST, top * RAISED, values)) @ vectors.T


def cyclic(lags: np.ndarray, nz: int, taper: int | None = None) -> np.ndarray:
    """(3, 3, nz): covariances by cyclic lag, of which every frequency's matrix is positive definite.

    Lags fade out linearly up to `taper` (all lags without). A pair (p, q) at a lag stands at (q, p) at its negative. Then
    each frequency's matrix has its eigenvalues raised to LEAST of the largest of all, and lag 0 gets its size back."""
    n = min(len(lags), nz // 2 + 1)
    fade = np.clip(1 - np.arange(n) / (taper or n), 0, None)
    out = np.zeros((*lags.shape[1:], nz))
    for k in range(n):
        out[:, :, k] += (fade[k] * lags[k]) / (2 if 2 * k == nz else 1)
        if k:
            out[:, :, nz - k] += (fade[k] * lags[k].T) / (2 if 2 * k == nz else 1)
    spectra = np.moveaxis(np.fft.fft(out, axis=2), 2, 0)
    values, vectors = np.linalg.eigh((spectra + spectra.conj().transpose(0, 2, 1)) / 2)
    values = np.maximum(values, LEAST * values.max())
    fixed = np.fft.ifft(np.moveaxis((vectors * values[:, None]) @ vectors.conj().transpose(0, 2, 1), 0, 2), axis=2).real
    size = np.sqrt(np.diagonal(out[:, :, 0]) / np.diagonal(fixed[:, :, 0]))
    return fixed * size[:, None, None] * size[None, :, None]
