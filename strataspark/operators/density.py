"""Facies probabilities from three elastic parameters: a smoothed density of each facies on bins, and its use on cells.

Samples are counted by bin in Spark; a density has a fixed number of bins (2 MB a facies), whatever the samples, so it may
be held by the driver and sent to all tasks, where cells are looked up a batch at a time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BINS = (100, 100, 50)
#: Standard deviations of the smoothing that the bins reach beyond the samples.
MARGIN = 5.0


@dataclass(frozen=True)
class Volume:
    """Bins: lower corner, sizes, counts, and the covariance of the smoothing."""

    low: np.ndarray
    step: np.ndarray
    bins: tuple[int, int, int]
    smoothing: np.ndarray

    def kernel(self) -> np.ndarray:
        """A normal density by cyclic lag of bins, of sum 1."""
        lags = np.meshgrid(*[s * np.where(np.arange(n) <= n // 2, np.arange(n), np.arange(n) - n) for s, n in zip(self.step, self.bins, strict=True)], indexing="ij")
        x = np.stack([v.ravel() for v in lags])
        found = np.exp(-0.5 * (x * np.linalg.solve(self.smoothing, x)).sum(axis=0)).reshape(self.bins)
        return found / found.sum()


def volume(samples: DataFrame, facies: str, values: list[str], noise: np.ndarray | None = None, bins: tuple[int, int, int] = BINS) -> Volume:
    """Bins for the samples that have facies and all values; one pass over them.

    The smoothing is the noise's covariance (none without) whose variances are at least those of the best bandwidth for
    so many samples of three normal parameters."""
    rows = samples.where(F.col(facies).isNotNull()).dropna(subset=values)
    r = rows.agg(F.count("*").alias("n"), *[f(v).alias(f"{f.__name__}{k}") for k, v in enumerate(values) for f in (F.min, F.max, F.var_samp)]).first()
    if r.n < 2:
        raise ValueError("two samples with facies and all values are needed at least")
    width = (4 / 7) ** (1 / 7) * r.n ** (-1 / 7)
    smoothing = np.zeros((3, 3)) if noise is None else np.array(noise, float)
    for k in range(3):
        smoothing[k, k] = max(smoothing[k, k], width**2 * r[f"var_samp{k}"], 1e-12)
    margin = MARGIN * np.sqrt(np.diag(smoothing))
    low, high = (np.array([r[f"{f}{k}"] for k in range(3)]) for f in ("min", "max"))
    return Volume(low - margin, (high - low + 2 * margin) / bins, bins, smoothing)


def counted(samples: DataFrame, facies: str, values: list[str], box: Volume) -> DataFrame:
    """(facies, a, b, c, n): samples in each bin that has any."""
    bins = [F.least(F.floor((F.col(v) - lo) / s), F.lit(n - 1)).cast("int").alias(c) for c, v, lo, s, n in zip("abc", values, box.low.tolist(), box.step.tolist(), box.bins, strict=True)]
    return samples.where(F.col(facies).isNotNull()).dropna(subset=values).groupBy(F.col(facies).alias("facies"), *bins).agg(F.count("*").alias("n"))


def densities(samples: DataFrame, facies: str, values: list[str], box: Volume) -> dict[object, np.ndarray]:
    """{facies: array of bins, of sum 1}: counts over the facies' samples, smoothed by convolution in frequency.

    A facies' counts (a row for each bin at most) meet in one task, which gives its density back by planes."""
    kernel = np.fft.rfftn(box.kernel())

    def smooth(pdf: pd.DataFrame) -> pd.DataFrame:
        hist = np.zeros(box.bins)
        hist[pdf["a"], pdf["b"], pdf["c"]] = pdf["n"] / pdf["n"].sum()
        found = np.maximum(np.fft.irfftn(np.fft.rfftn(hist) * kernel, box.bins), 0)
        return pd.DataFrame({"facies": pdf["facies"].iloc[0], "a": range(box.bins[0]), "plane": [x.astype(np.float32).tobytes() for x in found]})

    counts = counted(samples, facies, values, box)
    schema = T.StructType([T.StructField("facies", counts.schema["facies"].dataType), T.StructField("a", T.IntegerType()), T.StructField("plane", T.BinaryType())])
    found: dict[object, np.ndarray] = {}
    for r in counts.groupBy("facies").applyInPandas(smooth, schema).collect():
        found.setdefault(r.facies, np.zeros(box.bins, np.float32))[r.a] = np.frombuffer(r.plane, np.float32).reshape(box.bins[1:])
    return found


def interpolated(density: np.ndarray, box: Volume, x: np.ndarray) -> np.ndarray:
    """Density at points (n, 3): linear between the centres of bins, constant beyond them."""
    at = np.clip((x - box.low) / box.step - 0.5, 0, np.array(box.bins) - 1)
    base = np.minimum(np.floor(at).astype(int), np.maximum(np.array(box.bins) - 2, 0))
    part, out = at - base, np.zeros(len(x))
    for corner in np.ndindex(2, 2, 2):
        weight = np.prod(np.where(corner, part, 1 - part), axis=1)
        place = np.minimum(base + corner, np.array(box.bins) - 1)
        out += weight * density[place[:, 0], place[:, 1], place[:, 2]]
    return out


def probabilities(cells: DataFrame, values: list[str], found: dict[object, np.ndarray], box: Volume, prior: dict[object, float], undefined: float = 0.01) -> DataFrame:
    """`cells` with p_<facies> for each facies, and p_undefined: prior times density over their sum and an undefined share.

    The undefined share is spread evenly over all bins. A cell that lacks a value has nulls."""
    names, share = sorted(found, key=str), undefined / np.prod(box.bins)
    columns = [*[f"p_{f}" for f in names], "p_undefined"]
    sent = cells.sparkSession.sparkContext.broadcast([found[f] for f in names])

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(v).to_numpy(zero_copy_only=False).astype(float) for v in values], axis=1)
            lack = np.isnan(x).any(axis=1)
            x[lack] = 0
            p = np.stack([prior.get(f, 0.0) * interpolated(d, box, x) for f, d in zip(names, sent.value, strict=True)] + [np.full(len(x), share)])
            p /= p.sum(axis=0)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(v, mask=lack) for v in p]], names=[*batch.schema.names, *columns])

    return cells.mapInArrow(looked_up, T.StructType([*cells.schema.fields, *[T.StructField(c, T.DoubleType()) for c in columns]]))


def directions(prior: np.ndarray, posterior: np.ndarray) -> np.ndarray:
    """(2, 3): the combinations of the parameters that the data tell most of: eigenvectors of prior^-1 posterior but for that of the largest eigenvalue."""
    root = np.linalg.cholesky(prior)
    half = np.linalg.solve(root, np.linalg.solve(root, posterior).T)
    _, vectors = np.linalg.eigh((half + half.T) / 2)
    found = np.linalg.solve(root.T, vectors[:, :2])
    return (found / np.linalg.norm(found, axis=0)).T
