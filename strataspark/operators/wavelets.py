"""Wavelets from wells: spectral division of a well's seismic trace by its reflections, averaged over wells.

A well is one row with its arrays, and rows are independent but for two sums over all wells: that which tells the
polarity, and the average. Both are Spark aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataspark.sources.ranges import durable


def aligned_wells(blocks: DataFrame, keys: list[str], layer: str, impedance: str, seismic: str, least: int) -> DataFrame:
    """(keys, start, length, reflections, seismic): arrays over each well's longest run of layers that have both values.

    A reflection stands at the top of its layer, the run's first is 0. Wells whose run has at most `least` layers are
    left out. Layers are whole numbers, one row each. Of equally long runs the first is taken."""
    rows = blocks.where(F.col(impedance).isNotNull() & F.col(seismic).isNotNull()).select(*keys, F.col(layer).cast("long").alias("_k"), F.col(impedance).cast("double").alias("_e"), F.col(seismic).cast("double").alias("_s"))
    w = Window.partitionBy(*keys).orderBy("_k")
    rows = rows.withColumn("_run", F.col("_k") - F.row_number().over(w))
    runs = rows.groupBy(*keys, "_run").agg(F.min("_k").alias("start"), F.count("*").alias("length"))
    best = runs.groupBy(*keys).agg(F.max_by(F.struct("_run", "start", "length"), F.struct("length", -F.col("start"))).alias("r")).select(*keys, "r.*").where(F.col("length") > least)
    kept = rows.join(best, [*keys, "_run"])
    whole = kept.groupBy(*keys, "start", "length").agg(F.sort_array(F.collect_list(F.struct("_k", "_e", "_s"))).alias("_rows"))
    e = F.transform("_rows", lambda r: r["_e"])
    steps = F.transform(e, lambda v, k: F.when(k == 0, 0.0).otherwise(v - F.get(e, k - 1)))
    return whole.select(*keys, "start", "length", steps.alias("reflections"), F.transform("_rows", lambda r: r["_s"]).alias("seismic"))


def taper(n: int, dz: float, length: float) -> np.ndarray:
    """Papoulis' window over cyclic lags: 1 at lag 0, 0 from half the wavelet's length on."""
    far = np.minimum(np.arange(n), n - np.arange(n)) * dz / (length / 2)
    return np.where(far < 1, np.abs(np.sin(np.pi * far)) / np.pi + (1 - far) * np.cos(np.pi * far), 0.0)


def without_constant(x: np.ndarray, dz: float, length: float) -> np.ndarray:
    """The wavelet without its lowest frequencies: as much of the window's spectrum is taken off each amplitude as makes the mean zero."""
    window = taper(len(x), dz, length)
    far = np.minimum(np.arange(len(x)), len(x) - np.arange(len(x))) * dz
    z, t = np.fft.rfft(np.where((far < length / 2) | (np.arange(len(x)) == 0), x, 0.0)), np.abs(np.fft.rfft(window))
    size = np.abs(z)
    z = np.where(size > 0, z * (size - size[0] / t[0] * t) / np.where(size > 0, size, 1), 0)
    z[0] = 0
    return np.fft.irfft(z, len(x))


def shifted(x: np.ndarray, by: float) -> np.ndarray:
    """A cyclic array moved by `by` samples, which needn't be whole."""
    return np.fft.irfft(np.fft.rfft(x) * np.exp(-2j * np.pi * by * np.arange(len(x) // 2 + 1) / len(x)), len(x))


def best_shift(cross: np.ndarray, polarity: int, most: float) -> float:
    """Lag of the largest cross-correlation of that sign within `most` samples, refined by a parabola; 0 if there is none."""
    lags = np.arange(-int(np.floor(most)), int(np.ceil(most)))
    values = polarity * cross[lags]
    if not len(lags) or values.max() <= 0:
        return 0.0
    # Of equal ones the first lag of 0, 1, 2, ..., then -1, -2, ...
    order = np.lexsort((np.where(lags >= 0, lags, len(lags) - lags), -values))
    at = int(lags[order[0]])
    before, here, after = (polarity * cross[(at + d) % len(cross)] for d in (-1, 0, 1))
    curve = before + after - 2 * here
    return at + (before - after) / (2 * curve) if (before < here if at < 0 else after < here) and curve < 0 else float(at)


def _arrays(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
    return [np.asarray(v.values.to_numpy(zero_copy_only=False), float) for v in batch.column(name)]


def _doubles(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([x.tolist() for x in arrays], pa.list_(pa.float64()))


def estimated(wells: DataFrame, keys: list[str], nz: int, dz: float, length: float, max_shift: float) -> tuple[DataFrame, np.ndarray]:
    """((keys, weight, shift, wavelet) of each well, the average wavelet), cyclic over nz samples with time zero first.

    `wells` has arrays `reflections` and `seismic` of at most nz samples (see `aligned_wells`), `dz` and `max_shift` are in
    the unit of `length`, the wavelet's. A well weighs by its length and its reflections' energy. The sign of the sum of all
    wells' cross-correlations near lag 0 is the polarity; each well is shifted to its largest cross-correlation of that
    sign, and its wavelet is cross- by auto-correlation, both tapered, in frequency. Without wells it is an error."""
    names = ", ".join(f"`{k}` {wells.schema[k].dataType.simpleString()}" for k in keys)
    reach = (int(np.ceil(max_shift / dz)), int(np.floor(max_shift / dz)))

    def correlated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            auto, cross, weight, near = [], [], [], []
            for r, s in zip(_arrays(batch, "reflections"), _arrays(batch, "seismic"), strict=True):
                if len(r) > nz or len(s) != len(r):
                    raise ValueError(f"a well of {len(r)} and {len(s)} samples doesn't fit {nz}")
                a, b = np.fft.rfft(r, nz), np.fft.rfft(s, nz)
                auto.append(np.fft.irfft(a * a.conj(), nz))
                cross.append(np.fft.irfft(a.conj() * b, nz))
                weight.append(len(r) * dz * (auto[-1][0] + auto[-1][1]))
                near.append(cross[-1][: reach[0]].sum() + cross[-1][nz - reach[1] :].sum() if reach[1] else cross[-1][: reach[0]].sum())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), _doubles(auto), _doubles(cross), pa.array(weight, pa.float64()), pa.array(near, pa.float64())], names=[*keys, "auto", "cross", "weight", "near"])

    found = durable(wells.mapInArrow(correlated, f"{names}, auto array<double>, cross array<double>, weight double, near double").where("weight > 0"))
    total, near = found.agg(F.sum("weight"), F.sum("near")).first()
    if total is None:
        raise ValueError("no wells left for wavelet estimation")
    polarity = 1 if near > 0 else -1

    def divided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window = taper(nz, dz, length)
        for batch in batches:
            shifts, out = [], []
            for auto, cross in zip(_arrays(batch, "auto"), _arrays(batch, "cross"), strict=True):
                by = best_shift(cross, polarity, max_shift / dz)
                top = without_constant(shifted(cross, -by) * window, dz, length)
                # The window's transform is not negative, so neither is that of the tapered auto-correlation.
                out.append(np.fft.irfft(np.fft.rfft(top) / np.fft.rfft(auto * window).real, nz))
                shifts.append(by * dz)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), batch.column("weight"), pa.array(shifts, pa.float64()), _doubles(out)], names=[*keys, "weight", "shift", "wavelet"])

    by_well = durable(found.mapInArrow(divided, f"{names}, weight double, shift double, wavelet array<double>"))
    sums = by_well.select("weight", F.posexplode("wavelet").alias("k", "v")).groupBy("k").agg((F.sum(F.col("weight") * F.col("v")) / total).alias("v")).orderBy("k").toPandas()
    return by_well, without_constant(sums["v"].to_numpy(), dz, length)


def signal_to_noise(wells: DataFrame, by_well: DataFrame, keys: list[str], wavelet: np.ndarray, dz: float) -> DataFrame:
    """(keys, n, data_variance, error_variance, ratio, scale) of each well: its trace against the synthetic one.

    The wavelet is moved by the well's shift; `scale` is the factor of the synthetic trace that leaves the least error, and
    the error is what it leaves. A trace without energy has a null ratio."""
    names = ", ".join(f"`{k}` {wells.schema[k].dataType.simpleString()}" for k in keys)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r, s, shift in zip(_arrays(batch, "reflections"), _arrays(batch, "seismic"), batch.column("shift").to_pylist(), strict=True):
                n = len(wavelet)
                synthetic = np.fft.irfft(np.fft.rfft(r, n) * np.fft.rfft(shifted(wavelet, shift / dz)), n)[: len(s)]
                energy = (synthetic**2).sum()
                scale = (synthetic * s).sum() / energy if energy else 0.0
                error = ((s - scale * synthetic) ** 2).mean()
                rows.append((len(s), (s**2).mean(), error, (s**2).mean() / error if error > 0 else None, scale))
            columns = [pa.array([x[k] for x in rows], pa.int64() if k == 0 else pa.float64()) for k in range(5)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *columns], names=[*keys, "n", "data_variance", "error_variance", "ratio", "scale"])

    joined = wells.join(by_well.select(*keys, "shift"), keys)
    return joined.mapInArrow(compared, f"{names}, n long, data_variance double, error_variance double, ratio double, scale double")
