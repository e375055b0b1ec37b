"""Vertical trend of a log: the mean of each layer over all wells, smoothed by local lines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Data behind a layer's line, at least: this many, this many milliseconds of layers, this many a well.
LEAST, MILLISECONDS, A_WELL = 10, 50.0, 5.0


def least_data(wells: int, dz: float) -> int:
    return max(LEAST, int(MILLISECONDS / dz), int(A_WELL * wells))


def layer_means(blocks: DataFrame, keys: list[str], layer: str, value: str) -> DataFrame:
    """(keys, layer, mean, n): what the regression needs of any number of wells."""
    return blocks.where(F.col(value).isNotNull()).groupBy(*keys, layer).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def local_lines(layers: DataFrame, keys: list[str], layer: str, nz: int, least: int, low: float, high: float) -> DataFrame:
    """(keys, layer, trend, kind) of all layers 0 to nz - 1, given those that have data (layer, mean, n).

    A layer's trend is the value there of the line through the means of the layers around it, weighted by their data. The
    layers around are those of the narrowest symmetric window with `least` data, twice as many above the first layer with
    data and below the last; a window that reaches both ends is taken as it is. `kind`: a line, the mean where one layer
    alone has data, and what stands in for lines outside `low` to `high`: the first or last trend for layers above or below
    the data, the mean of all data for every layer if a line among the data fails. Groups have nz rows at most."""
    schema = T.StructType([*[layers.schema[k] for k in keys], T.StructField(layer, T.LongType()), T.StructField("trend", T.DoubleType()), T.StructField("kind", T.StringType())])

    def smooth(pdf: pd.DataFrame) -> pd.DataFrame:
        trend, kind = _lines(pdf[layer].to_numpy(np.int64), pdf["mean"].to_numpy(float), pdf["n"].to_numpy(float), nz, least, low, high)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] * nz for k in keys}, layer: range(nz), "trend": trend, "kind": kind})

    known = layers.where(F.col(layer).between(0, nz - 1) & (F.col("n") > 0))
    return known.select(*keys, layer, "mean", "n").groupBy(*keys).applyInPandas(smooth, schema)


def _lines(at: np.ndarray, mean: np.ndarray, n: np.ndarray, nz: int, least: int, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    sums = np.zeros((nz + 1, 6))
    np.add.at(sums, at + 1, np.stack([n, n * at, n * mean, n * at * at, n * at * mean, n > 0], axis=1))
    sums = sums.cumsum(axis=0)
    k = np.arange(nz)
    inside = (k >= at.min()) & (k <= at.max())
    need = np.where(inside, least, 2 * least)
    within = lambda r: sums[np.minimum(k + r, nz - 1) + 1] - sums[np.maximum(k - r, 0)]
    narrow, wide = np.full(nz, -1), np.full(nz, nz)  # a radius with too few data, and one with enough (or all)
    while (wide - narrow > 1).any():
        middle = (narrow + wide) // 2
        enough = within(middle)[:, 0] >= need
        narrow, wide = np.where(~enough & (wide - narrow > 1), middle, narrow), np.where(enough & (wide - narrow > 1), middle, wide)
    total, x, y, xx, xy, layers = within(wide).T
    x, y, xx, xy = x / total, y / total, xx / total, xy / total
    one = layers < 2
    slope = np.where(one, 0, (xy - x * y) / np.where(one, 1, xx - x * x))
    found = y + slope * (k - x)
    kind = np.where(one, "mean", "line").astype(object)
    bad = ~one & ((found < low) | (found > high))
    if (bad & inside).any():
        return np.full(nz, (n * mean).sum() / n.sum()), np.full(nz, "mean of all", object)
    for part, end, name in ((k < at.min(), at.min(), "first"), (k > at.max(), at.max(), "last")):
        if (bad & part).any():
            found[part], kind[part] = found[end], name
    return found, kind
