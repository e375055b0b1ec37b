"""Time-lapse state of a cell: static and dynamic parts of ln vp, ln vs, ln rho, with their whole covariance.

Vintages of a cell are a handful, but they may arrive late and in any order. So a stream keeps each cell's vintages in
order of event time and filters them again from the prior; batch and stream are the same fold."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: How the six parts make the current three: their sum.
SUM = np.hstack([np.eye(3), np.eye(3)])


@dataclass(frozen=True)
class Evolution:
    """What a year does: the dynamic part keeps `decay` of itself and its mean moves by `drift`; `noise` is the dynamic covariance it gains."""

    decay: np.ndarray
    drift: np.ndarray
    noise: np.ndarray

    def over(self, years: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(matrix, mean, covariance) of a step of any length, so that two steps make the step of their sum."""
        d = np.asarray(self.decay, float)
        kept = d**years
        same = np.outer(d, d)
        grown = lambda x: np.where(np.isclose(x, 1), years, (1 - x**years) / np.where(np.isclose(x, 1), 1, 1 - x))
        matrix, mean, cov = np.eye(6), np.zeros(6), np.zeros((6, 6))
        matrix[3:, 3:] = np.diag(kept)
        mean[3:] = self.drift * grown(d)
        cov[3:, 3:] = self.noise * grown(same)
        return matrix, mean, cov


def evolved(mean: np.ndarray, cov: np.ndarray, evolution: Evolution, years: float) -> tuple[np.ndarray, np.ndarray]:
    a, m, q = evolution.over(years)
    return a @ mean + m, a @ cov @ a.T + q


def merged(mean: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distribution of the current three parameters."""
    return SUM @ mean, SUM @ cov @ SUM.T


def split(mean: np.ndarray, cov: np.ndarray, new_mean: np.ndarray, new_cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The state whose current three parameters have a new distribution, all else given them as before.

    Directions that the current state knows exactly stay as they are."""
    now_mean, now_cov = merged(mean, cov)
    gain = cov @ SUM.T @ np.linalg.pinv(now_cov, rcond=1e-10, hermitian=True)
    found = cov - gain @ (now_cov - new_cov) @ gain.T
    return mean + gain @ (new_mean - now_mean), (found + found.T) / 2


def observed(mean: np.ndarray, cov: np.ndarray, part: np.ndarray, data: np.ndarray, noise: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The state after data = part @ state + noise; part (m, 6) may pick single parameters."""
    gain = np.linalg.solve(part @ cov @ part.T + noise, part @ cov).T
    found = cov - gain @ part @ cov
    return mean + gain @ (data - part @ mean), (found + found.T) / 2


@dataclass(frozen=True)
class Prior:
    """State before the first vintage, at `start` (years)."""

    mean: np.ndarray
    cov: np.ndarray
    start: float


def filtered(vintages: list[tuple[float, np.ndarray, np.ndarray]], prior: Prior, evolution: Evolution) -> tuple[np.ndarray, np.ndarray, float]:
    """(mean, covariance, time) after vintages (time, three observed means, their error variances), in order of time.

    A component that wasn't observed is NaN. Those of one time are taken one after the other, in order of their values.
    Vintages before the prior's start are used at the start."""
    mean, cov, now = prior.mean, prior.cov, prior.start
    for time, data, variance in sorted(vintages, key=lambda v: (v[0], tuple(v[1]), tuple(v[2]))):
        if time > now:
            mean, cov = evolved(mean, cov, evolution, time - now)
            now = time
        has = ~np.isnan(data) & (variance > 0)
        if has.any():
            mean, cov = observed(mean, cov, SUM[has], data[has], np.diag(variance[has]))
    return mean, cov, now


def _scaled(cov: np.ndarray, kept: np.ndarray) -> np.ndarray:
    return cov * kept[:, :, None] * kept[:, None, :]


def filtered_together(counts: np.ndarray, time: np.ndarray, data: np.ndarray, variance: np.ndarray, prior: Prior, evolution: Evolution) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`filtered` for many cells at once, one vintage of each at a time: (means, covariances, times).

    Cell k has the next counts[k] rows of time (n), data and variance (n, 3). Errors of components are independent, so
    they are taken one after the other. Of values that are NaN, the order is last."""
    cells = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((*variance.T[::-1], *data.T[::-1], time, cells))
    time, data, variance = time[order], data[order], variance[order]
    # Cells with most vintages first, so that those that have a further one are the first of them.
    rank = np.argsort(-counts, kind="stable")
    counts, first = counts[rank], (np.cumsum(counts) - counts)[rank]
    mean, cov, now = np.tile(np.asarray(prior.mean, float), (len(counts), 1)), np.tile(np.asarray(prior.cov, float), (len(counts), 1, 1)), np.full(len(counts), float(prior.start))
    d = np.asarray(evolution.decay, float)
    grown = lambda x, y: np.where(np.isclose(x, 1), y, (1 - x**y) / np.where(np.isclose(x, 1), 1, 1 - x))
    for step in range(int(counts.max(initial=0))):
        n = int(np.searchsorted(-counts, -step, "left"))
        at = first[:n] + step
        m, c = mean[:n], cov[:n]
        years = np.where(time[at] > now[:n], time[at] - now[:n], 0.0)
        kept = np.hstack([np.ones((n, 3)), d ** years[:, None]])
        m *= kept
        m[:, 3:] += evolution.drift * grown(d, years[:, None])
        c[:] = _scaled(c, kept)
        c[:, 3:, 3:] += evolution.noise * grown(np.outer(d, d), years[:, None, None])
        now[:n] = np.where(time[at] > now[:n], time[at], now[:n])
        for k in range(3):
            has = ~np.isnan(data[at, k]) & (variance[at, k] > 0)
            spread = c[:, :, k] + c[:, :, k + 3]
            gain = np.where(has, 1 / np.where(has, spread[:, k] + spread[:, k + 3] + variance[at, k], 1), 0.0)[:, None] * spread
            m += gain * np.where(has, data[at, k] - m[:, k] - m[:, k + 3], 0.0)[:, None]
            c -= gain[:, :, None] * spread[:, None, :]
    back = np.argsort(rank)
    return mean[back], cov[back], now[back]


def _vintages(times: list, data: list, variances: list) -> list[tuple[float, np.ndarray, np.ndarray]]:
    wide = lambda x: np.array([np.nan if v is None else v for v in x], float)
    return [(float(t), wide(d), wide(v)) for t, d, v in zip(times, data, variances, strict=True)]


def _schema(rows: DataFrame, keys: list[str]) -> T.StructType:
    numbers = T.ArrayType(T.DoubleType())
    return T.StructType([*[rows.schema[k] for k in keys], T.StructField("n", T.LongType()), T.StructField("time", T.DoubleType()), T.StructField("mean", numbers), T.StructField("covariance", numbers)])


def states(vintages: DataFrame, keys: list[str], prior: Prior, evolution: Evolution) -> DataFrame:
    """(keys, n, time, mean of six, covariance of 36) of each cell after all its vintages (keys, time, data, variance).

    data and variance are arrays of three; a null component wasn't observed, a vintage without time doesn't count."""
    schema = _schema(vintages, keys)
    parts = [f"{c}{k}" for c in ("data", "variance") for k in range(3)]
    one = F.struct(F.col("time").cast("double").alias("time"), *[F.get(F.col(p[:-1]).cast("array<double>"), F.lit(int(p[-1]))).alias(p) for p in parts])
    cells = vintages.groupBy(*keys).agg(F.collect_list(F.when(F.col("time").isNotNull(), one)).alias("vintages"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vintages")
            counts, rows = np.diff(column.offsets.to_numpy()).astype(np.int64), column.flatten()
            wide = lambda c, rows=rows: rows.field(c).to_numpy(zero_copy_only=False).astype(float)
            data, variance = (np.stack([wide(p) for p in ps], axis=1) for ps in (parts[:3], parts[3:]))
            mean, cov, now = filtered_together(counts, wide("time"), data, variance, prior, evolution)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1) * n, pa.int32()), pa.array(x.reshape(-1))) for x, n in ((mean, 6), (cov, 36))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(counts), pa.array(now), *lists], names=[f.name for f in schema])

    return cells.mapInArrow(fold, schema)


def streamed_states(vintages: DataFrame, keys: list[str], prior: Prior, evolution: Evolution) -> DataFrame:
    """As `states`, for a stream (update mode): a cell's row comes again whenever it gets a vintage, late ones included.

    The state of a cell is its vintages, seven numbers each, so that one that belongs in between finds its place."""
    numbers = T.ArrayType(T.DoubleType())
    kept = T.StructType([T.StructField("times", numbers), T.StructField("data", numbers), T.StructField("variances", numbers)])

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, data, variances = map(list, state.get) if state.exists else ([], [], [])
        for pdf in frames:
            ok = pdf[pdf["time"].notna()]
            for t, d, v in _vintages(ok["time"].tolist(), ok["data"].tolist(), ok["variance"].tolist()):
                times.append(t)
                data += d.tolist()
                variances += v.tolist()
        state.update((times, data, variances))
        mean, cov, now = filtered(_vintages(times, np.reshape(data, (-1, 3)).tolist(), np.reshape(variances, (-1, 3)).tolist()), prior, evolution)
        yield pd.DataFrame({**{k: [v] for k, v in zip(keys, key, strict=True)}, "n": [len(times)], "time": [now], "mean": [mean.tolist()], "covariance": [cov.ravel().tolist()]})

    rows = vintages.select(*keys, "time", "data", "variance")
    return rows.groupBy(*keys).applyInPandasWithState(update, _schema(vintages, keys), kept, "update", GroupStateTimeout.NoTimeout)
