"""Operators along ordered traces: resampling, smoothing, peaks, matching, transforms."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def resampled(samples: DataFrame, keys: list[str], z: str, value: str) -> DataFrame:
    """(keys, k, value) on the well's mean step, one place for each sample: means within half a step; both ends are copied.

    A place that no sample is near has a null."""
    w = Window.partitionBy(*keys)
    rows = samples.select(*keys, z, value, F.min(z).over(w).alias("_z0"), F.max(z).over(w).alias("_z1"), F.count("*").over(w).alias("_n"))
    k = F.floor(F.try_divide((F.col(z) - F.col("_z0")) * (F.col("_n") - 1), F.col("_z1") - F.col("_z0")) + 0.5)
    bins = rows.groupBy(*keys, F.coalesce(k, F.lit(0)).alias("k"))
    out = bins.agg(F.max("_n").alias("_n"), F.avg(value).alias("_mean"), F.min_by(value, z).alias("_first"), F.max_by(value, z).alias("_last"))
    out = out.select(*keys, "k", F.when(F.col("k") == 0, F.col("_first")).when(F.col("k") == F.col("_n") - 1, F.col("_last")).otherwise(F.col("_mean")).alias(value))
    places = samples.groupBy(*keys).agg(F.count("*").alias("_n")).select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("k"))
    return places.join(out, [*keys, "k"], "left")


def extrapolated(samples: DataFrame, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    """Holes take the last value before them, those at the start the first after."""
    w = Window.partitionBy(*keys).orderBy(order)
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    return samples.withColumn(out, F.coalesce(F.last(value, ignorenulls=True).over(before), F.first(value, ignorenulls=True).over(after)))


def smoothed(rows: DataFrame, keys: list[str], order: str, value: str, out: str, sigma: float, half: int) -> DataFrame:
    """Gaussian mean over `half` samples on either side, its weights renormalised where samples are missing."""
    w = Window.partitionBy(*keys).orderBy(order)
    total, weights = F.lit(0.0), F.lit(0.0)
    for d in range(-half, half + 1):
        v, g = F.lag(value, d).over(w), math.exp(-0.5 * (d / sigma) ** 2)
        total, weights = total + F.coalesce(v * g, F.lit(0.0)), weights + F.when(v.isNotNull(), g).otherwise(0.0)
    return rows.withColumn(out, F.try_divide(total, weights))


def peaks(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """`rows` at local extrema, with the refined place (in samples from the row's) and height of a parabola."""
    w = Window.partitionBy(*keys).orderBy(order)
    marked = rows.withColumn("_a", F.lag(value).over(w)).withColumn("_b", F.col(value)).withColumn("_c", F.lead(value).over(w))
    found = marked.where("(_b >= _a AND _b > _c) OR (_b <= _a AND _b < _c)")  # the last sample of a plateau
    shift = (F.col("_a") - F.col("_c")) / (2 * (F.col("_a") - 2 * F.col("_b") + F.col("_c")))
    return found.withColumn("shift", shift).withColumn("peak", F.col("_b") - (F.col("_a") - F.col("_c")) * F.col("shift") / 4).drop("_a", "_b", "_c")


def best_scale(rows: DataFrame, keys: list[str], synthetic: str, seismic: str, n: int = 95, most: float = 5.0) -> DataFrame:
    """(keys, scale, misfit): of `n` scales from 1 / `most` to `most`, evenly spaced by their logarithm, the one of least squares.

    The misfit of every scale follows from three sums, so the samples are read once."""
    s, d = F.col(synthetic), F.col(seismic)
    sums = rows.where(s.isNotNull() & d.isNotNull()).groupBy(*keys).agg(F.sum(s * s).alias("_ss"), F.sum(s * d).alias("_sd"), F.sum(d * d).alias("_dd"))
    scale = F.explode(F.array(*[F.lit(math.exp(math.log(most) * (2 * k / (n - 1) - 1))) for k in range(n)])).alias("scale")
    each = sums.select("*", scale).withColumn("misfit", F.col("scale") * F.col("scale") * F.col("_ss") - 2 * F.col("scale") * F.col("_sd") + F.col("_dd"))
    return each.groupBy(*keys).agg(F.min_by(F.struct("scale", "misfit"), F.struct("misfit", "scale")).alias("r")).select(*keys, "r.scale", "r.misfit")


def best_shift(rows: DataFrame, keys: list[str], layer: str, a: str, b: str, most: int) -> DataFrame:
    """(keys, shift, score): the shift of `b` against `a`, in layers, of the largest summed product; the smallest of equal ones.

    Each layer is sent to the 2 * `most` + 1 layers it may meet: an equi-join, not all pairs."""
    left = rows.select(*keys, F.col(layer).alias("_k"), F.col(a).alias("_a"), F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("shift")).withColumn("_at", F.col("_k") + F.col("shift"))
    right = rows.select(*keys, F.col(layer).alias("_at"), F.col(b).alias("_b"))
    scores = left.join(right, [*keys, "_at"]).groupBy(*keys, "shift").agg(F.sum(F.col("_a") * F.col("_b")).alias("score"))
    best = F.max_by(F.struct("shift", "score"), F.struct(F.round("score", 6), -F.abs("shift"), -F.col("shift"))).alias("r")
    return scores.where("score IS NOT NULL").groupBy(*keys).agg(best).select(*keys, "r.shift", "r.score")


def class_runs(rows: DataFrame, keys: list[str], order: str, facies: str) -> DataFrame:
    """(keys, facies, n_runs, n): how many runs of equal classes, and samples, each class has."""
    w = Window.partitionBy(*keys).orderBy(order)
    first = rows.select(*keys, facies, (~F.lag(facies).over(w).eqNullSafe(F.col(facies))).cast("long").alias("_new"))
    return first.groupBy(*keys, facies).agg(F.sum("_new").alias("n_runs"), F.count("*").alias("n"))


def refined(traces: DataFrame, value: str, out: str, factor: int) -> DataFrame:
    """Array traces on a grid `factor` times as fine: the line between the ends is taken off, the rest is padded in frequency."""

    def refine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(**{out: [_refined(np.asarray(t, float), factor) for t in pdf[value]]})

    return traces.mapInPandas(refine, T.StructType([*traces.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))]))


def _refined(x: np.ndarray, factor: int) -> list[float]:
    n = len(x)
    if n < 2:
        return np.repeat(x, factor).tolist()
    slope = (x[-1] - x[0]) / (n - 1)
    spectrum = np.fft.rfft(x - x[0] - slope * np.arange(n))
    if n % 2 == 0:
        spectrum[-1] /= 2
    return (factor * np.fft.irfft(spectrum, n * factor) + x[0] + slope * np.arange(n * factor) / factor).tolist()


def transformed(cells: DataFrame, axes: tuple[str, str, str], inverse: bool = False) -> DataFrame:
    """Three-dimensional Fourier transform of cells (axes, re, im), dense from 0: one shuffle for each axis, a line a group."""
    schema = ", ".join(f"{c} long" for c in axes) + ", re double, im double"
    turn = np.fft.ifft if inverse else np.fft.fft
    rows = cells.select(*[F.col(c).cast("long").alias(c) for c in axes], F.col("re").cast("double").alias("re"), F.col("im").cast("double").alias("im"))

    def along(axis: str):
        def line(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(axis)
            z = turn(pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy())
            return pdf.assign(re=z.real, im=z.imag)

        return line

    for axis in axes:
        rows = rows.groupBy(*[c for c in axes if c != axis]).applyInPandas(along(axis), schema)
    return rows
