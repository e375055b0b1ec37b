"""Simple kriging and co-kriging by blocks of space: each block is solved once, from the data in and around it.

Data are sent to the blocks whose halo they lie in, targets to their own. Beyond `limit` places only those nearest to the
block count, as in any kriging neighbourhood; they are ranked before the shuffle, so a crowded place stays small."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Targets that one matrix of covariances takes at once.
CHUNK = 4096


def krige_blocks(
    data: DataFrame, targets: DataFrame, keys: list[str], coords: list[str], values: list[str], covariance: np.ndarray, correlation: Callable[..., np.ndarray], block: list[float], reach: list[float], limit: int = 200,
) -> DataFrame:
    """`targets` (keys, coords and others) with a column `<value>_kriged` for each of `values`, residuals from the trend.

    Data of the same keys count. `covariance` is that of the values at one place, `correlation(*lags)` (numpy) what a lag
    leaves of it. A value is estimated from its own data; a place that lacks it takes part with the values it has. Data at
    one place are averaged first. Blocks are boxes of sizes `block`; data up to `reach` from a block's box take part, the
    nearest `limit` places of them (by distance in units of `reach`, then by place). Targets without data are 0. Rows with
    a null coordinate are no data; such targets are null."""
    some = reduce(lambda a, b: a | b, [F.col(v).isNotNull() for v in values])
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in coords])
    places = data.where(some & whole).groupBy(*keys, *[F.col(c).cast("double").alias(c) for c in coords]).agg(*[F.avg(v).alias(v) for v in values])
    cell = lambda c, size: F.floor(F.col(c) / size).cast("long")
    boxes = [f"_b{k}" for k in range(len(coords))]
    rows = targets.withColumns({b: cell(c, s) for b, c, s in zip(boxes, coords, block, strict=True)})
    used = rows.select(*keys, *boxes).distinct()
    sent = places
    for b, c, s, r in zip(boxes, coords, block, reach, strict=True):
        sent = sent.withColumn(b, F.explode(F.sequence(F.floor((F.col(c) - r) / s), F.floor((F.col(c) + r) / s))))

    def outside(b: str, c: str, s: float, r: float) -> Column:
        return F.pow(F.greatest(F.lit(0.0), F.col(b) * s - F.col(c), F.col(c) - (F.col(b) + 1) * s) / r, F.lit(2.0))

    far = reduce(lambda a, b: a + b, [outside(*x) for x in zip(boxes, coords, block, reach, strict=True)])
    nearest = Window.partitionBy(*keys, *boxes).orderBy("_far", *coords)
    sent = sent.join(used, [*keys, *boxes], "left_semi").withColumn("_far", far).withColumn("_rank", F.row_number().over(nearest)).where(F.col("_rank") <= limit).drop("_far", "_rank")
    sent = sent.toDF(*sent.columns)  # data and targets may come from one table
    names = [f"{v}_kriged" for v in values]

    def solved(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        at = left[coords].to_numpy(float)
        if not len(left) or np.isnan(at).any() or not len(right):
            return left.assign(**{n: np.nan if np.isnan(at).any() else 0.0 for n in names})[out_columns]
        right = right.sort_values(coords)
        return left.assign(**dict(zip(names, _solve(at, right[coords].to_numpy(float), right[values].to_numpy(float), covariance, correlation).T, strict=True)))[out_columns]

    out_columns = [*targets.columns, *names]
    schema = T.StructType([*targets.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])
    found = rows.groupBy(*keys, *boxes).cogroup(sent.groupBy(*keys, *boxes)).applyInPandas(solved, schema)
    return found.withColumns({n: F.nanvl(n, F.lit(None).cast("double")) for n in names})


def _solve(at: np.ndarray, place: np.ndarray, known: np.ndarray, covariance: np.ndarray, correlation: Callable[..., np.ndarray]) -> np.ndarray:
    """(targets, values) estimates: one factorisation for each pattern of values that lack."""
    out = np.zeros((len(at), known.shape[1]))
    has = ~np.isnan(known)
    lags = [place[:, None, k] - place[None, :, k] for k in range(place.shape[1])]
    between = correlation(*lags)
    for g in range(known.shape[1]):
        own = has[:, g]
        use = np.where(own[:, None], np.arange(known.shape[1]) == g, has)
        i, p = np.nonzero(use)
        if not len(i):
            continue
        weight = _positive_solve(covariance[np.ix_(p, p)] * between[np.ix_(i, i)], known[i, p])
        for k in range(0, len(at), CHUNK):
            part = at[k : k + CHUNK]
            near = correlation(*[part[:, None, c] - place[None, :, c] for c in range(place.shape[1])])
            out[k : k + CHUNK, g] = (covariance[g, p] * near[:, i]) @ weight
    return out


def _positive_solve(matrix: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solution by Cholesky; a matrix that isn't positive definite gets a growing share of its diagonal more."""
    more = 0.0
    while True:
        try:
            low = np.linalg.cholesky(matrix + more * np.diag(np.diag(matrix)))
            return np.linalg.solve(low.T, np.linalg.solve(low, right))
        except np.linalg.LinAlgError:
            more = max(1e-9, 10 * more)
