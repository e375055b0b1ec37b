"""Differential effective medium: moduli of a host into which inclusions are put bit by bit.

The two equations are solved for a whole batch of rows at once, each with its own step, by a pair of embedded
Runge-Kutta rules (Dormand and Prince, 1980). The inclusions' shape factors are those of Berryman (1980) for spheroids."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Nodes, stage weights, and both rules' weights of Dormand and Prince.
NODES = (0, 1 / 5, 3 / 10, 4 / 5, 8 / 9, 1, 1)
STAGES = (
    (),
    (1 / 5,),
    (3 / 40, 9 / 40),
    (44 / 45, -56 / 15, 32 / 9),
    (19372 / 6561, -25360 / 2187, 64448 / 6561, -212 / 729),
    (9017 / 3168, -355 / 33, 46732 / 5247, 49 / 176, -5103 / 18656),
    (35 / 384, 0, 500 / 1113, 125 / 192, -2187 / 6784, 11 / 84),
)
FIFTH = (35 / 384, 0, 500 / 1113, 125 / 192, -2187 / 6784, 11 / 84, 0)
FOURTH = (5179 / 57600, 0, 7571 / 16695, 393 / 640, -92097 / 339200, 187 / 2100, 1 / 40)
#: What stands for a sphere (the factors divide by zero there), and how much of the host always stays.
SPHERE, FULL = 0.99, 0.999999


def shape_factors(k: np.ndarray, mu: np.ndarray, ki: np.ndarray, mui: np.ndarray, aspect: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(P, Q) of oblate spheroids (aspect up to 1) of moduli ki, mui in a host of moduli k, mu: Berryman's factors."""
    al = np.where(aspect == 1, SPHERE, aspect)
    flat = 1 - al**2
    th = al / flat**1.5 * (np.arccos(al) - al * np.sqrt(flat))
    f = al**2 / flat * (3 * th - 2)
    nu = (3 * k - 2 * mu) / (2 * (3 * k + mu))
    r = (1 - 2 * nu) / (2 * (1 - nu))
    a, b = mui / mu - 1, (ki / k - mui / mu) / 3
    bend = b * (3 - 4 * r)
    f1 = 1 + a * (1.5 * (f + th) - r * (1.5 * f + 2.5 * th - 4 / 3))
    f2 = 1 + a * (1 + 1.5 * (f + th) - r / 2 * (3 * f + 5 * th)) + bend + a / 2 * (a + 3 * b) * (3 - 4 * r) * (f + th - r * (f - th + 2 * th**2))
    f3 = 1 + a * (1 - (f + 1.5 * th) + r * (f + th))
    f4 = 1 + a / 4 * (f + 3 * th - r * (f - th))
    f5 = a * (-f + r * (f + th - 4 / 3)) + bend * th
    f6 = 1 + a * (1 + f - r * (f + th)) + bend * (1 - th)
    f7 = 2 + a / 4 * (3 * f + 9 * th - r * (3 * f + 5 * th)) + bend * th
    f8 = a * (1 - 2 * r + f / 2 * (r - 1) + th / 2 * (5 * r - 3)) + bend * (1 - th)
    f9 = a * ((r - 1) * f - r * th) + bend * th
    return f1 / f2, (2 / f3 + 1 / f4 + (f4 * f5 + f6 * f7 - f8 * f9) / (f2 * f4)) / 5


def _slope(y: np.ndarray, t: np.ndarray, ki: np.ndarray, mui: np.ndarray, aspect: np.ndarray, share: np.ndarray) -> np.ndarray:
    """d(k, mu) / dt of rows (2, n); inclusions are (m, n), their shares sum to 1."""
    p, q = shape_factors(y[0], y[1], ki, mui, aspect)
    return np.stack([(share * (ki - y[0]) * p).sum(axis=0), (share * (mui - y[1]) * q).sum(axis=0)]) / (1 - t)


def effective_moduli(host: np.ndarray, ki: np.ndarray, mui: np.ndarray, aspect: np.ndarray, part: np.ndarray, tolerance: float = 1e-7) -> np.ndarray:
    """(2, n) bulk and shear moduli of hosts (2, n) with inclusions (m, n) that make up `part` of the whole.

    Parts sum to 1 at most; one inclusion that is everything is the result. Where several are, a millionth of the host
    stays. Rows that have no solution (parts over 1, aspects over 1, moduli not positive) are NaN."""
    total = part.sum(axis=0)
    end = np.where((total >= 1) & (len(part) > 1), FULL, total)
    # An inclusion of no part may have any moduli.
    good = (host > 0).all(axis=0) & (total <= 1 + 1e-12) & (part >= 0).all(axis=0) & ((part == 0) | ((aspect > 0) & (aspect <= 1) & (ki > 0) & (mui >= 0))).all(axis=0)
    only = good & (total >= 1) & (len(part) == 1)
    y = np.where(good, host, np.nan).astype(float)
    share = part / np.where(total > 0, total, 1)
    t, h = np.zeros(len(total)), np.minimum(end, 0.05)
    going = good & ~only & (end > 0)
    while going.any():
        i = np.flatnonzero(going)
        step = np.minimum(h[i], end[i] - t[i])
        args = (ki[:, i], mui[:, i], aspect[:, i], share[:, i])
        slopes: list[np.ndarray] = []
        with np.errstate(all="ignore"):
            for node, weights in zip(NODES, STAGES, strict=True):
                slopes.append(_slope(y[:, i] + step * sum((w * s for w, s in zip(weights, slopes, strict=True)), np.zeros((2, len(i)))), t[i] + node * step, *args))
            new = y[:, i] + step * sum(w * s for w, s in zip(FIFTH, slopes, strict=True))
            off = (np.abs(step * sum((v - w) * s for v, w, s in zip(FIFTH, FOURTH, slopes, strict=True))) / (tolerance * np.maximum(np.abs(y[:, i]), 1e-9))).max(axis=0)
        off = np.where(np.isfinite(off) & np.isfinite(new).all(axis=0), off, 1e9)
        ok = off <= 1
        y[:, i[ok]] = new[:, ok]
        t[i[ok]] += step[ok]
        h[i] = step * np.clip(0.9 * np.maximum(off, 1e-12) ** -0.2, 0.1, 5)
        lost = ~ok & (step < 1e-12)
        y[:, i[lost]] = np.nan
        going[i] = (t[i] < end[i] * (1 - 1e-12)) & ~lost
    y[:, only] = np.stack([ki[0], mui[0]])[:, only]
    return y


def dem(host_k: Column, host_mu: Column, inclusions: list[tuple[Column, Column, Column, Column]], tolerance: float = 1e-7) -> Column:
    """Struct (k, mu) of a host with inclusions (bulk modulus, shear modulus, aspect ratio, part of the whole); null without solution."""

    @F.pandas_udf("k double, mu double")
    def solved(*columns: pd.Series) -> pd.DataFrame:
        x = np.stack([c.to_numpy(float, na_value=np.nan) for c in columns])
        found = effective_moduli(x[:2], *(x[2 + c :: 4] for c in range(4)), tolerance)
        return pd.DataFrame({"k": found[0], "mu": found[1]})

    out = solved(host_k, host_mu, *[c for inclusion in inclusions for c in inclusion])
    return F.when(~F.isnan(out["k"]) & out["k"].isNotNull(), out)
