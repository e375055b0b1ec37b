"""Statistics of wells: ratios, deviations from a trend, variances, and how well facies probabilities fit the facies."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Scale of the statistic, and the p-values under which a fit is poor, bad and very bad.
SCALE, POOR, BAD, VERY_BAD = 0.3, 0.05, 0.025, 0.005


def mean_ratios(samples: DataFrame, keys: list[str], upper: str, lower: str) -> DataFrame:
    """(keys, n, mean_ratio, overall): mean of upper / lower over samples that have both, and that of all, each sample alike.

    Wells without such samples have n = 0 and no mean."""
    ratio = F.try_divide(F.col(upper), F.col(lower))
    wells = samples.groupBy(*keys).agg(F.count(ratio).alias("n"), F.avg(ratio).alias("mean_ratio"))
    every = samples.agg(F.avg(ratio).alias("overall"))
    return wells.crossJoin(F.broadcast(every))


def trend_deviation(blocks: DataFrame, trend: DataFrame, keys: list[str], layer: str, value: str, trend_value: str) -> DataFrame:
    """(keys, n, deviation): root mean square of exp(value) - exp(trend) of each well; 0 where it has no value."""
    rows = blocks.select(*keys, layer, F.col(value).alias("_v")).join(trend.select(layer, F.col(trend_value).alias("_t")), layer, "left")
    difference = F.exp("_v") - F.exp("_t")
    return rows.groupBy(*keys).agg(F.count(difference).alias("n"), F.sqrt(F.coalesce(F.avg(difference * difference), F.lit(0.0))).alias("deviation"))


def parameter_variances(samples: DataFrame, facies: str, values: list[str]) -> DataFrame:
    """n and the sample variance of each value over samples whose facies is known."""
    return samples.where(F.col(facies).isNotNull()).agg(F.count("*").alias("n"), *[F.var_samp(v).alias(f"var_{v}") for v in values])


@F.pandas_udf(T.DoubleType())
def chi_square_tail(x: pd.Series, freedom: pd.Series) -> pd.Series:
    """Chance of a chi-square of `freedom` degrees (1 or more) being over x; null for others."""
    return pd.Series(upper_gamma(freedom.to_numpy(float, na_value=np.nan) / 2, x.to_numpy(float, na_value=np.nan) / 2))


def upper_gamma(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised upper incomplete gamma function of a whole batch (NaN below a = 1 / 2): a series below a + 1, else Lentz's continued fraction.

    Both take about the root of a steps at most, and all entries step together."""
    ok = (a >= 0.5) & ~np.isnan(x)
    a, x = np.where(ok, a, 1.0), np.where(ok, np.maximum(x, 0), 1.0)
    scale = np.exp(a * np.log(np.maximum(x, 1e-300)) - x - np.array([math.lgamma(v) for v in a]))
    low = x < a + 1
    term = total = 1 / a
    step = a.copy()
    while (low & (term > total * 1e-16)).any():
        step = step + 1
        term = term * np.where(low, x, 0.0) / step
        total = total + term
    b = x + 1 - a
    c, d = np.full(len(a), 1e300), 1 / np.where(b == 0, 1e-300, b)
    h, i = d.copy(), 0
    moving = ~low
    while moving.any():
        i += 1
        n = -i * (i - a)
        b = b + 2
        d = 1 / np.where(n * d + b == 0, 1e-300, n * d + b)
        c = np.where(b + n / c == 0, 1e-300, b + n / c)
        h = np.where(moving, h * d * c, h)
        moving &= (np.abs(d * c - 1) > 1e-15) & (i < 100_000)
    found = np.where(low, 1 - scale * total, scale * h)
    return np.where(ok, np.where(x == 0, 1.0, np.clip(found, 0, 1)), np.nan)


def facies_fit(blocks: DataFrame, keys: list[str], order: str, facies: str, probabilities: dict[str, Column]) -> DataFrame:
    """(keys, n_runs, chi, freedom, p_value, fit) of the probabilities of facies along each well.

    A run of blocks of one facies is one observation: its length against the sum of each facies' probability. Blocks
    without facies count in no run. With one facies of any probability there is no test (null)."""
    w = Window.partitionBy(*keys).orderBy(order)
    names = list(probabilities)
    rows = blocks.select(*keys, order, F.col(facies).alias("_f"), *[p.alias(f"_p{i}") for i, p in enumerate(probabilities.values())])
    present = rows.groupBy(*keys).agg(sum(((F.sum(f"_p{i}") != 0).cast("int") for i in range(len(names))), F.lit(0)).alias("_actual"))
    new = (~F.lag("_f").over(w).eqNullSafe(F.col("_f"))).cast("long")
    runs = rows.where(F.col("_f").isNotNull()).withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    runs = runs.groupBy(*keys, "_run", "_f").agg(F.count("*").alias("_n"), *[F.sum(f"_p{i}").alias(f"_p{i}") for i in range(len(names))])
    part = lambda i, name: F.coalesce(F.try_divide(F.pow(F.when(F.col("_f") == name, F.col("_n")).otherwise(0) - F.col(f"_p{i}"), F.lit(2.0)), F.col(f"_p{i}")), F.lit(0.0))
    wells = runs.groupBy(*keys).agg(F.count("*").alias("n_runs"), (SCALE * F.sum(sum((part(i, n) for i, n in enumerate(names)), F.lit(0.0)))).alias("chi"))
    found = wells.join(present, keys).withColumn("freedom", F.when(F.col("_actual") > 1, (F.col("_actual") - 1) * F.col("n_runs")))
    found = found.withColumn("p_value", chi_square_tail("chi", F.col("freedom").cast("double")))
    p = F.col("p_value")
    label = F.when(p >= POOR, "good").when(p >= BAD, "poor").when(p >= VERY_BAD, "bad").when(p.isNotNull(), "very bad")
    return found.select(*keys, "n_runs", "chi", "freedom", "p_value", label.alias("fit"))
