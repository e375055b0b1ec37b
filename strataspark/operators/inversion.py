"""Kriging and Bayesian linear inversion: small dense solves in numpy, one per layer, trace or frequency."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cokriging import krige_blocks


def krige(data: DataFrame, targets: DataFrame, layer: str, range_: float, power: float = 1.0, trend: float = 0.0, tile: float = 2.0, reach: float = 3.0, limit: int = 200) -> DataFrame:
    """Simple kriging of residuals (layer, x, y, value) onto `targets` (layer, x, y), with general-exponential correlation.

    Each layer is cut into squares of `tile` ranges; a square is solved once from the `limit` places nearest to it within
    `reach` ranges (see `krige_blocks`), so that a layer of any number of wells is many small solves. Without data the
    trend stays."""
    known = data.where(F.col("value").isNotNull()).select(layer, "x", "y", (F.col("value") - trend).alias("value"))
    rows = targets.select(F.col(layer), F.col("x").cast("double"), F.col("y").cast("double"))
    decay = lambda dx, dy: np.exp(-3 * (np.hypot(dx, dy) / range_) ** power)
    found = krige_blocks(known, rows, [layer], ["x", "y"], ["value"], np.eye(1), decay, [tile * range_] * 2, [reach * range_] * 2, limit)
    return found.select(layer, "x", "y", (F.col("value_kriged") + trend).alias("kriged"))


def invert(rows: DataFrame, forward: np.ndarray, prior_cov: np.ndarray, noise_cov: np.ndarray, prior_mean: str, data: str) -> DataFrame:
    """Posterior mean and covariance trace of a linear Gaussian model d = G m + e, for each row (a frequency or a cell).

    `rows` has arrays `prior_mean` (of len(prior_cov)) and `data`. The gain is the same for all rows, so a batch is one
    matrix product. Where the data covariance isn't positive definite, the prior stays."""
    g = np.asarray(forward, float)
    try:
        cov = g @ prior_cov @ g.T + noise_cov
        np.linalg.cholesky(cov)
        gain = prior_cov @ g.T @ np.linalg.inv(cov)
    except np.linalg.LinAlgError:
        gain = np.zeros((len(prior_cov), len(g)))
    left = float(np.trace(prior_cov - gain @ g @ prior_cov))
    schema = T.StructType([*rows.schema.fields, T.StructField("posterior", T.ArrayType(T.DoubleType())), T.StructField("posterior_trace", T.DoubleType())])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                m, d = np.array(pdf[prior_mean].tolist(), float), np.array(pdf[data].tolist(), float)
                yield pdf.assign(posterior=(m + (d - m @ g.T) @ gain.T).tolist(), posterior_trace=left)

    return rows.mapInPandas(solve, schema)
