"""Logs of wells filtered to what an inversion resolves: I - posterior * prior^-1, over the blocks of each well.

A well is cut into windows of neighbouring blocks with a halo; each window is one dense problem, so that a well of any
length is many small ones."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .spectral import Shape, to_traces

#: What is added to the prior variances, and in proportion to the posterior ones, for stability.
REGULARISATION = 1e-4

#: Covariance of the three parameters at lags (di, dj, dk), arrays of one shape: (..., 3, 3).
Covariance = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def lag_table(blocks: DataFrame, shape: Shape, reach_i: int, reach_j: int) -> Covariance:
    """Posterior covariance by lag, from blocks of nine covariances (see `spectral.inverted`), for lateral lags up to the reach.

    What comes to the driver is the traces of those lags. Larger lateral lags have covariance 0."""
    lag = lambda v, n: F.when(F.col(v) > n // 2, F.col(v) - n).otherwise(F.col(v))
    rows = to_traces(blocks, Shape(shape.nx, shape.ny, shape.nz, 9, shape.block_z, shape.block_i))
    near = rows.select(lag("i", shape.nx).alias("i"), lag("j", shape.ny).alias("j"), "v").where((F.abs("i") <= reach_i) & (F.abs("j") <= reach_j))
    table = np.zeros((2 * reach_i + 1, 2 * reach_j + 1, shape.nz, 3, 3))
    scale = np.sqrt(shape.nx * shape.ny * shape.nz)
    for r in near.collect():
        table[r.i + reach_i, r.j + reach_j] = np.reshape(r.v, (3, 3, shape.nz)).transpose(2, 0, 1) / scale

    def at(di: np.ndarray, dj: np.ndarray, dk: np.ndarray) -> np.ndarray:
        inside = (np.abs(di) <= reach_i) & (np.abs(dj) <= reach_j)
        found = table[np.where(inside, di, 0) + reach_i, np.where(inside, dj, 0) + reach_j, dk % shape.nz]
        return np.where(inside[..., None, None], found, 0)

    return at


def filter_matrix(i: np.ndarray, j: np.ndarray, k: np.ndarray, prior: Covariance, posterior: Covariance) -> tuple[np.ndarray, np.ndarray]:
    """(filter, posterior covariance) of n blocks, (3 n, 3 n), the parameters of a block one after the other."""
    lags = [v[:, None] - v[None] for v in (i, j, k)]
    n = 3 * len(i)
    before, after = (c(*lags).transpose(0, 2, 1, 3).reshape(n, n) for c in (prior, posterior))
    before, after = (before + before.T) / 2, (after + after.T) / 2
    after = after + np.diag(REGULARISATION * np.diag(after) / np.maximum(np.diag(before), 1e-300))
    before = before + REGULARISATION * np.eye(n)
    return np.eye(n) - np.linalg.solve(before, after).T, after


def filtered(blocks: DataFrame, keys: list[str], cell: tuple[str, str, str], values: list[str], prior: Covariance, posterior: Covariance, window: int = 64, halo: int = 64) -> DataFrame:
    """`blocks` with `<value>_filtered` for each of three residuals, and `error`: the nine covariances of what the filter leaves unknown.

    `cell` names the block's cell (i, j, k); blocks are taken in order of k, then i and j. A residual that lacks counts as 0
    and its filtered value is null. A block is filtered with the blocks of its window and `halo` blocks on either side."""
    order = Window.partitionBy(*keys).orderBy(cell[2], cell[0], cell[1])
    ranked = blocks.withColumn("_rank", F.row_number().over(order) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    first, last = F.greatest(F.lit(0), F.floor((F.col("_rank") - halo) / window)), F.floor(F.least(F.col("_rank") + halo, F.col("_n") - 1) / window)
    rows = ranked.withColumn("_window", F.explode(F.sequence(first, last)))
    names = [f"{v}_filtered" for v in values]
    schema = T.StructType([*blocks.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names], T.StructField("error", T.ArrayType(T.DoubleType()))])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_rank")
        own = (pdf["_rank"] // window == pdf["_window"]).to_numpy()
        x = pdf[values].to_numpy(float, na_value=np.nan)
        matrix, after = filter_matrix(*(pdf[c].to_numpy(np.int64) for c in cell), prior, posterior)
        out = (matrix @ np.nan_to_num(x).ravel()).reshape(-1, 3)
        left = matrix @ after
        n = len(pdf)
        error = left.reshape(n, 3, n, 3)[np.arange(n), :, np.arange(n)]
        error = (error + error.transpose(0, 2, 1)) / 2
        out[np.isnan(x)] = np.nan
        found = pdf.assign(**dict(zip(names, out.T, strict=True)), error=list(error.reshape(n, 9)))
        return found.loc[own, [f.name for f in schema]]

    found = rows.groupBy(*keys, "_window").applyInPandas(solve, schema)
    return found.withColumns({n: F.nanvl(n, F.lit(None).cast("double")) for n in names})


def error_covariance(found: DataFrame) -> np.ndarray:
    """Mean of the blocks' error covariances, 3 x 3: the noise that smooths the densities of facies."""
    r = found.agg(*[F.avg(F.get("error", F.lit(k))) for k in range(9)]).first()
    return np.array([v or 0.0 for v in r]).reshape(3, 3)
