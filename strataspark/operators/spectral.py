"""Inversion of seismic angle stacks by frequency: the padded cube is transformed, each frequency vector is a small solve.

A cube is dealt out in pencils. Traces are transformed along z where they lie; one shuffle brings together lines along i
(for a block of frequencies), a second one lines along j. What a frequency needs then stands in one block of rows, and
the way back is the same. No task holds more than a line of blocks, whatever the cube."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspark.functions.padding import mirror_index
from strataspark.sources.ranges import durable

#: Bytes of a line of blocks that one group of a shuffle gathers, about.
GROUP = 8 << 20


@dataclass(frozen=True)
class Shape:
    """Cells of a padded cube, and how many of its frequencies along z and i a block takes (set from GROUP where not given)."""

    nx: int
    ny: int
    nz: int
    channels: int
    block_z: int = 0
    block_i: int = 0

    def __post_init__(self):
        if not self.block_z:
            object.__setattr__(self, "block_z", max(1, min(self.nf, GROUP // (16 * self.channels * self.nx))))
            object.__setattr__(self, "block_i", max(1, min(self.nx, GROUP // (16 * self.channels * self.ny * self.block_z))))

    @property
    def nf(self) -> int:
        return self.nz // 2 + 1


def padded(traces: DataFrame, nx: int, ny: int, shape: Shape) -> DataFrame:
    """(i, j, v): traces (i, j, v) of the nx * ny cube, each copied to the places of the padded one that mirror it.

    v holds the channels one after the other. A padded place takes the trace that `mirror_index` names, so that the cube
    goes on without a step at its ends."""

    def places(n: int, to: int, c: str) -> DataFrame:
        at = traces.sparkSession.range(to).select(mirror_index(F.col("id"), F.lit(n), F.lit(to)).cast("int").alias(f"{c}0"), F.col("id").cast("int").alias(c))
        return F.broadcast(at.groupBy(f"{c}0").agg(F.collect_list(c).alias(f"{c}s")))

    rows = traces.select(F.col("i").cast("int").alias("i0"), F.col("j").cast("int").alias("j0"), "v")
    rows = rows.join(places(nx, shape.nx, "i"), "i0").join(places(ny, shape.ny, "j"), "j0")
    return rows.withColumn("i", F.explode("is")).withColumn("j", F.explode("js")).select("i", "j", "v")


def _blob(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x, np.complex128).tobytes()


def to_frequencies(traces: DataFrame, shape: Shape) -> DataFrame:
    """(bi, bz, data): the unitary transform of dense traces (i, j, v), in blocks of frequencies.

    data is a complex array (channels, frequencies along i of the block, ny, frequencies along z of the block)."""

    def along_z(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(n, shape.channels, shape.nz)
            z = np.fft.rfft(v, axis=2, norm="ortho")
            cuts = range(0, shape.nf, shape.block_z)
            i, j = (np.repeat(batch.column(c).to_numpy(), len(cuts)) for c in "ij")
            data = [_blob(z[r, :, c : c + shape.block_z]) for r in range(n) for c in cuts]
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(np.tile(np.arange(len(cuts), dtype=np.int32), n)), pa.array(data, pa.binary())], names=["i", "j", "bz", "data"])

    def along_i(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        z = _stacked(pdf.sort_values("i"), "i", shape.nx, (shape.channels, -1))
        z = np.fft.fft(z, axis=0, norm="ortho")
        cuts = range(0, shape.nx, shape.block_i)
        return pd.DataFrame({"bi": np.arange(len(cuts), dtype=np.int32), "j": key[0], "bz": key[1], "data": [_blob(z[c : c + shape.block_i].transpose(1, 0, 2)) for c in cuts]})

    def along_j(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        width = min(shape.block_i, shape.nx - key[0] * shape.block_i)
        z = _stacked(pdf.sort_values("j"), "j", shape.ny, (shape.channels, width, -1))
        return pd.DataFrame({"bi": [key[0]], "bz": [key[1]], "data": [_blob(np.fft.fft(z, axis=0, norm="ortho").transpose(1, 2, 0, 3))]})

    rows = traces.select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.col("v").cast("array<double>").alias("v")).mapInArrow(along_z, "i int, j int, bz int, data binary")
    rows = rows.groupBy("j", "bz").applyInPandas(along_i, "bi int, j int, bz int, data binary")
    return rows.groupBy("bi", "bz").applyInPandas(along_j, "bi int, bz int, data binary")


def _stacked(pdf: pd.DataFrame, axis: str, n: int, inner: tuple) -> np.ndarray:
    """Blobs of a whole line, in order, as one array; a line with holes or repeated places is an error."""
    if len(pdf) != n or not np.array_equal(pdf[axis].to_numpy(), np.arange(n)):
        raise ValueError(f"a cube must have one trace at each place; along {axis} {len(pdf)} of {n} were found")
    return np.frombuffer(b"".join(pdf["data"]), np.complex128).reshape(n, *inner)


def to_traces(blocks: DataFrame, shape: Shape) -> DataFrame:
    """(i, j, v): the inverse of `to_frequencies` for blocks of `shape.channels` channels."""

    def along_j(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bi, bz, data in zip(batch.column("bi").to_pylist(), batch.column("bz").to_pylist(), batch.column("data"), strict=True):
                width = min(shape.block_i, shape.nx - bi * shape.block_i)
                z = np.frombuffer(data.as_buffer(), np.complex128).reshape(shape.channels, width, shape.ny, -1)
                z = np.fft.ifft(z, axis=2, norm="ortho")
                out = [_blob(z[:, :, j].transpose(1, 0, 2)) for j in range(shape.ny)]
                yield pa.RecordBatch.from_arrays([pa.array([bi] * shape.ny, pa.int32()), pa.array(range(shape.ny), pa.int32()), pa.array([bz] * shape.ny, pa.int32()), pa.array(out, pa.binary())], names=["bi", "j", "bz", "data"])

    def along_i(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        z = np.frombuffer(b"".join(pdf.sort_values("bi")["data"]), np.complex128).reshape(shape.nx, shape.channels, -1)
        z = np.fft.ifft(z, axis=0, norm="ortho")
        return pd.DataFrame({"i": np.arange(shape.nx, dtype=np.int32), "j": key[0], "bz": key[1], "data": [_blob(x) for x in z]})

    def along_z(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(x, np.complex128).reshape(shape.channels, -1) for x in pdf.sort_values("bz")["data"]]
        v = np.fft.irfft(np.concatenate(parts, axis=1), shape.nz, axis=1, norm="ortho")
        return pd.DataFrame({"i": [key[0]], "j": [key[1]], "v": [v.ravel().tolist()]})

    rows = blocks.mapInArrow(along_j, "bi int, j int, bz int, data binary").groupBy("j", "bz").applyInPandas(along_i, "i int, j int, bz int, data binary")
    return rows.groupBy("i", "j").applyInPandas(along_z, "i int, j int, v array<double>")


def by_frequency(blocks: DataFrame, shape: Shape, f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Blocks with new channels: f gets (channels, n) and the frequency along z of each column, and gives (new channels, n)."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for bi, bz, data in zip(batch.column("bi").to_pylist(), batch.column("bz").to_pylist(), batch.column("data"), strict=True):
                width = min(shape.block_i, shape.nx - bi * shape.block_i)
                z = np.frombuffer(data.as_buffer(), np.complex128).reshape(shape.channels, width, shape.ny, -1)
                k = np.broadcast_to(bz * shape.block_z + np.arange(z.shape[3]), z.shape[1:])
                out.append(_blob(f(z.reshape(shape.channels, -1), k.ravel())))
            yield pa.RecordBatch.from_arrays([batch.column("bi"), batch.column("bz"), pa.array(out, pa.binary())], names=["bi", "bz", "data"])

    return blocks.mapInArrow(mapped, "bi int, bz int, data binary")


@dataclass(frozen=True)
class Model:
    """What all frequencies share.

    reflection: (angles, 3), how changes of ln vp, ln vs, ln rho make reflections. wavelets: (angles, nz), time zero first,
    cyclic. auto: (3, 3, nz), prior covariance by lag along z, cyclic. noise: (angles, angles), covariance of the errors.
    white: the share of white noise; the rest follows the wavelet and its third difference. Only frequencies between `low`
    and `high` (in steps of 1 / nz) are inverted."""

    reflection: np.ndarray
    wavelets: np.ndarray
    auto: np.ndarray
    noise: np.ndarray
    white: float = 0.1
    low: float = 0.0
    high: float = float("inf")

    def spectra(self) -> dict[str, np.ndarray]:
        """By frequency along z: the operator K (nf, angles, 3), prior (nf, 3, 3), coloured and white noise (nf, angles, angles)."""
        n = self.wavelets.shape[1]
        forward = np.zeros(n)
        forward[0], forward[-1] = -1, 1  # x(t + 1) - x(t)
        w, d = np.fft.rfft(self.wavelets, axis=1), np.fft.rfft(forward)
        operator = (w * d).T[:, :, None] * self.reflection
        third = np.roll(self.wavelets, -1, axis=1) - self.wavelets
        third = third - np.roll(third, 1, axis=1)
        third = (np.roll(third, -1, axis=1) - np.roll(third, 1, axis=1)) / 2
        norm = lambda x: np.fft.rfft(x / np.maximum(np.sqrt((x**2).sum(axis=1)), 1e-300)[:, None], axis=1).T
        coloured = sum(x[:, :, None] * x[:, None].conj() for x in (norm(self.wavelets), norm(third)))
        prior = np.moveaxis(np.fft.rfft(self.auto, axis=2), 2, 0)
        return {"operator": operator, "prior": prior, "coloured": 0.5 * (1 - self.white) * self.noise * coloured, "white": self.white * np.diag(np.diag(self.noise))}


def lateral_impulse(i: np.ndarray, j: np.ndarray, shape: Shape, correlation: Callable[[np.ndarray, np.ndarray], np.ndarray], slope: tuple[float, float] = (0.0, 0.0)) -> np.ndarray:
    """(n, nz): the traces at (i, j) of the field whose spectrum is the lateral part of prior and noise.

    A lag (i, j), cyclic, has the correlation of its distance, at the layer to which layers dip by `slope` a cell; between
    two layers it is shared in proportion."""
    i, j = (np.where(v < n - v, v, v - n) for v, n in ((i, shape.nx), (j, shape.ny)))
    at = -(i * slope[0] + j * slope[1])
    base = np.floor(at).astype(int)
    out, rows, rest = np.zeros((len(i), shape.nz)), np.arange(len(i)), at - base
    value = correlation(i, j)
    np.add.at(out, (rows, base % shape.nz), (1 - rest) * value)
    np.add.at(out, (rows, (base + 1) % shape.nz), rest * value)
    return out


def _hermitian_solve(m: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(m^-1 b, where m is positive definite); zeros elsewhere."""
    good = np.linalg.eigvalsh(m)[:, 0] > 0
    out = np.zeros(b.shape, complex)
    if good.any():
        out[good] = np.linalg.solve(m[good], b[good])
    return out, good


def posterior(z: np.ndarray, k: np.ndarray, model: Model, parts: dict[str, np.ndarray], nz: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(means (3, n), residuals (angles, n), covariances (n, 3, 3)) of columns: angles, three prior means, lateral spectrum.

    Where the covariance of the data isn't positive definite, and outside the frequencies that are inverted, the prior stays."""
    angles = len(model.reflection)
    d, m, r = z[:angles].T, z[angles : angles + 3].T, z[angles + 3]
    # The unitary transform of an impulse is 1 / sqrt(cells) of the operator's.
    lateral = r.real
    prior = parts["prior"][k] * lateral[:, None, None]
    operator = parts["operator"][k]
    error = parts["coloured"][k] * np.abs(lateral)[:, None, None] + parts["white"]
    across = operator @ prior
    marginal = across @ operator.conj().transpose(0, 2, 1) + error
    gain, good = _hermitian_solve(marginal, across)
    good &= (k > model.low) & (k < model.high)
    gain[~good] = 0
    gain = gain.conj().transpose(0, 2, 1)
    mean = m + (gain @ (d - (operator @ m[:, :, None])[:, :, 0])[:, :, None])[:, :, 0]
    left = np.where(good[:, None], d - (operator @ mean[:, :, None])[:, :, 0], d)
    return mean.T, left.T, prior - gain @ across


def _root(cov: np.ndarray) -> np.ndarray:
    """Cholesky factors; zero where a covariance isn't positive definite."""
    cov = (cov + cov.conj().transpose(0, 2, 1)) / 2
    low, high = np.linalg.eigvalsh(cov)[:, 0], np.abs(cov).max(axis=(1, 2))
    good = low > 1e-12 * high
    out = np.zeros_like(cov)
    if good.any():
        out[good] = np.linalg.cholesky(cov[good])
    return out


def draws(i: np.ndarray, j: np.ndarray, seed: int, simulations: int, nz: int) -> np.ndarray:
    """(n, 3 * simulations * nz) standard normal numbers that depend on seed, simulation and place alone, whatever task makes them."""
    out = np.empty((len(i), simulations, 3 * nz))
    for s in range(simulations):
        for r, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
            out[r, s] = np.random.Generator(np.random.Philox(key=np.array([seed, s], np.uint64), counter=np.array([0, 0, a, b], np.uint64))).standard_normal(3 * nz)
    return out.reshape(len(i), -1)


def inverted(traces: DataFrame, nx: int, ny: int, shape: Shape, model: Model, correlation: Callable[[np.ndarray, np.ndarray], np.ndarray], slope: tuple[float, float] = (0.0, 0.0), simulations: int = 0, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Posterior of ln vp, ln vs, ln rho given angle stacks: (traces, blocks of posterior covariances).

    `traces` is (i, j, data, prior): the angle stacks, then the three prior means, each of shape.nz samples (padded along
    z) one after the other, at every place of the nx * ny cube, once. shape.channels is angles + 4 + 3 * simulations. The
    traces that come back, of the nx * ny cube, have `mean` (three channels), `residual` (a channel an angle) and `simulated`
    (three for each simulation: the mean and coloured noise). Noise is drawn by place and coloured by the root of each frequency's
    posterior covariance, so a draw is the same whatever the partitions and however often a task runs.
    The blocks are (bi, bz, data) of the nine posterior covariances: see `covariances`."""
    angles = len(model.reflection)
    if shape.channels != angles + 4 + 3 * simulations:
        raise ValueError(f"{angles + 4 + 3 * simulations} channels are needed")
    parts, scale = model.spectra(), np.sqrt(shape.nx * shape.ny * shape.nz)

    def completed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            i, j = batch.column("i").to_numpy(), batch.column("j").to_numpy()
            v = np.concatenate([v, scale * lateral_impulse(i, j, shape, correlation, slope), draws(i, j, seed, simulations, shape.nz)], axis=1)
            ends = pa.array(np.arange(n + 1) * v.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("i"), batch.column("j"), pa.ListArray.from_arrays(ends, pa.array(v.ravel()))], names=["i", "j", "v"])

    rows = padded(traces.select("i", "j", F.concat("data", "prior").alias("v")), nx, ny, shape).mapInArrow(completed, "i int, j int, v array<double>")
    blocks = durable(to_frequencies(rows, shape))

    def solved(z: np.ndarray, k: np.ndarray) -> np.ndarray:
        mean, left, cov = posterior(z, k, model, parts, shape.nz)
        noise = z[angles + 4 :].reshape(simulations, 3, z.shape[1])
        root = _root(cov) if simulations else None
        drawn = [mean + np.einsum("npq,qn->pn", root, x) for x in noise]
        return np.concatenate([mean, left, *drawn])

    out = replace(shape, channels=3 + angles + 3 * simulations)
    found = to_traces(by_frequency(blocks, shape, solved), out).where((F.col("i") < nx) & (F.col("j") < ny))
    part = lambda a, b: F.slice("v", a * shape.nz + 1, (b - a) * shape.nz)
    found = found.select("i", "j", part(0, 3).alias("mean"), part(3, 3 + angles).alias("residual"), part(3 + angles, out.channels).alias("simulated"))
    return found, by_frequency(blocks, shape, lambda z, k: posterior(z, k, model, parts, shape.nz)[2].reshape(len(k), 9).T)


def covariances(blocks: DataFrame, shape: Shape) -> np.ndarray:
    """(3, 3, nz): posterior covariance by lag along z at one place, summed over lateral frequencies within tasks."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bi, bz, data in zip(batch.column("bi").to_pylist(), batch.column("bz").to_pylist(), batch.column("data"), strict=True):
                width = min(shape.block_i, shape.nx - bi * shape.block_i)
                z = np.frombuffer(data.as_buffer(), np.complex128).reshape(9, width, shape.ny, -1).sum(axis=(1, 2)).T
                n = len(z)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(bz * shape.block_z + np.arange(n), 9)), pa.array(np.tile(np.arange(9), n)), pa.array(z.real.ravel()), pa.array(z.imag.ravel())], names=["k", "c", "re", "im"])

    found = blocks.mapInArrow(sums, "k long, c long, re double, im double").groupBy("k", "c").agg(F.sum("re").alias("re"), F.sum("im").alias("im")).toPandas()
    z = np.zeros((9, shape.nf), complex)
    z[found["c"], found["k"]] = found["re"] + 1j * found["im"]
    return (np.fft.irfft(z, shape.nz, axis=1) / (shape.nx * shape.ny)).reshape(3, 3, shape.nz)
