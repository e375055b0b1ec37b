"""Lateral geometry of a seismic survey: the grid that inlines and crosslines span, fitted to the traces' coordinates.

Traces are aggregated to three of them and to ranges and steps of the lines; the rest is arithmetic on these numbers.
The fitted geometry maps between lines, cells and coordinates by Column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Geometry:
    """A grid of nx * ny cells from corner (x0, y0), its first axis turned by `angle`. Inline and crossline of a place are
    il0 + (x - x0) * il_x + (y - y0) * il_y, and so on; cell (0, 0) has lines (first_il, first_xl), and a step along the
    inlines' axis adds il_step (which may be negative). `il_first`: whether inlines count along the first axis."""

    x0: float
    y0: float
    dx: float
    dy: float
    nx: int
    ny: int
    angle: float
    il0: float
    xl0: float
    il_x: float
    il_y: float
    xl_x: float
    xl_y: float
    first_il: int
    first_xl: int
    il_step: int
    xl_step: int
    il_first: bool
    xy: tuple[tuple[float, float], tuple[float, float]]  # (dx, dy) of one inline, and of one crossline
    ref: tuple[float, float, int, int]  # x, y, il, xl of a trace

    def lines(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Inline and crossline nearest to a place: half up, then cut to whole numbers."""
        return tuple(F.expr("0").cast("int") + (0.5 + c + (x - self.x0) * a + (y - self.y0) * b).cast("int") for c, a, b in ((self.il0, self.il_x, self.il_y), (self.xl0, self.xl_x, self.xl_y)))

    def place(self, il: Column, xl: Column) -> tuple[Column, Column]:
        """Coordinates of a trace's lines."""
        x, y, a, b = self.ref
        return tuple(v + (il - a) * self.xy[0][k] + (xl - b) * self.xy[1][k] for k, v in enumerate((x, y)))

    def cell(self, il: Column, xl: Column) -> tuple[Column, Column]:
        """(i, j) of the cell of a trace's lines, along the first and the second axis."""
        a, b = F.floor((il - self.first_il) / self.il_step), F.floor((xl - self.first_xl) / self.xl_step)
        return (a, b) if self.il_first else (b, a)

    def cell_at(self, x: Column, y: Column) -> tuple[Column, Column]:
        """(i, j) of the cell that a place lies in; null outside."""
        c, s = math.cos(self.angle), math.sin(self.angle)
        i = F.floor(((x - self.x0) * c + (y - self.y0) * s) / self.dx)
        j = F.floor(((y - self.y0) * c - (x - self.x0) * s) / self.dy)
        inside = (i >= 0) & (i < self.nx) & (j >= 0) & (j < self.ny)
        return F.when(inside, i), F.when(inside, j)


def orthogonal(il: np.ndarray, xl: np.ndarray, slope: float) -> tuple[np.ndarray, np.ndarray]:
    """Both axes at right angles, the inlines' along `slope`, with their lengths and the signs of their x."""
    turned = il[0] * np.array([1.0, slope]), xl[0] * np.array([1.0, -1 / slope])
    return tuple(v * np.hypot(*w) / np.hypot(*v) for v, w in zip(turned, (il, xl), strict=True))


def regularised(il: np.ndarray, xl: np.ndarray, corners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The axes made orthogonal if keeping the inlines' direction moves a corner by over a third of a step.

    Of eleven slopes between those of the two axes, that with the least move of the farther corner is taken; axes along
    x and y are orthogonal as they are, and stay."""
    if 0 in (il[0], il[1], xl[0], xl[1]):
        return il, xl

    def moves(slope: float) -> np.ndarray:
        a, b = orthogonal(il, xl, slope)
        return corners @ np.stack([a - il, b - xl])

    limit = np.minimum(np.abs(il), np.abs(xl)) / 3
    if (np.abs(moves(il[1] / il[0])).max(axis=0) <= limit).all():
        return il, xl
    slopes = np.linspace(*sorted((abs(il[1] / il[0]), abs(xl[0] / xl[1]))), 11)
    return orthogonal(il, xl, min(slopes, key=lambda s: np.hypot(*moves(s).T).max()))


def fitted(traces: DataFrame, regularise: bool = False) -> Geometry:
    """The geometry of traces (il, xl, x, y, and `trace`, their order). Traces without lines don't count.

    Three traces fix it: the first, that with lines farthest from it, and that with the largest sum of distances to both
    (of equal ones the first). The step of a line is its least difference from the first trace. Traces over half a step
    from where their lines put them are an error, and so is a table without two traces of different lines."""
    rows = traces.where("il IS NOT NULL AND xl IS NOT NULL").select("trace", "il", "xl", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    whole = F.struct("il", "xl", "x", "y")
    p0 = rows.agg(F.min_by(whole, "trace")).first()[0]
    if p0 is None:
        raise ValueError("no traces to set up a geometry from")
    far = lambda p: (F.col("il") - p.il) * (F.col("il") - p.il) + (F.col("xl") - p.xl) * (F.col("xl") - p.xl)
    step = lambda c, v: F.min(F.when(F.col(c) != v, F.abs(F.col(c) - v)))
    found = rows.agg(F.max_by(whole, F.struct(far(p0), -F.col("trace"))), *(f(c) for c in ("il", "xl") for f in (F.min, F.max)), step("il", p0.il), step("xl", p0.xl)).first()
    p1, (il_low, il_high, xl_low, xl_high), il_step, xl_step = found[0], found[1:5], found[5] or 0, found[6] or 0
    p2, most = rows.agg(F.max_by(F.struct(whole, F.sqrt(far(p0)) + F.sqrt(far(p1))), F.struct(F.sqrt(far(p0)) + F.sqrt(far(p1)), -F.col("trace")))).first()[0]
    corners = np.array([[p.il - p0.il, p.xl - p0.xl] for p in (p1, p2)], float)
    moved = np.array([[p.x - p0.x, p.y - p0.y] for p in (p1, p2)])
    if not corners.any():
        raise ValueError("all traces have the same lines")
    if most > np.hypot(*corners[0]) + 0.005:
        il, xl = np.linalg.solve(corners, moved)
        if regularise:
            il, xl = regularised(il, xl, corners)
    else:  # one line: along inlines, along crosslines, or across both (then x goes with crosslines, y with inlines)
        (a, b), (x, y) = corners[0], moved[0]
        il, xl = (np.array([x / a, y / a]), np.zeros(2)) if b == 0 else (np.zeros(2), np.array([x / b, y / b])) if a == 0 else (np.array([0, y / a]), np.array([x / b, 0]))
    geometry = _grid(p0, il, xl, (il_low, il_high, il_step), (xl_low, xl_high, xl_step))
    x, y = geometry.place(F.col("il"), F.col("xl"))
    off = (F.col("x") - x) ** 2 + (F.col("y") - y) ** 2
    worst = rows.agg(F.max_by(F.struct("il", "xl", "x", "y", off.alias("off")), off)).first()[0]
    limit = 0.25 * min(v for v in ((il**2).sum(), (xl**2).sum()) if v > 0)
    if worst.off > limit:
        raise ValueError(f"inline {worst.il}, crossline {worst.xl} at ({worst.x:.2f}, {worst.y:.2f}) is {math.sqrt(worst.off):.2f} from where the geometry puts it")
    return geometry


def _grid(ref, il: np.ndarray, xl: np.ndarray, il_range: tuple[int, int, int], xl_range: tuple[int, int, int]) -> Geometry:
    """Cells around the traces. The axis nearer to the x axis is the first one; both are turned to rising x and y."""
    lines = [(il, *il_range), (xl, *xl_range)]
    length = [np.hypot(*v) for v, *_ in lines]
    steep = [abs(v[1]) > abs(v[0]) for v, *_ in lines]
    first = 0 if (length[1] == 0 and not steep[0]) or (length[0] == 0 and steep[1]) else 1 if length[0] == 0 or length[1] == 0 else int(steep[0] and not steep[1] or (steep[0] == steep[1] and abs(il[1]) * length[1] > abs(xl[1]) * length[0]))
    axes, counts, starts, steps = [], [], [], []
    for k in (first, 1 - first):
        v, low, high, step = lines[k]
        along = 0 if k == first else 1
        rising = v[along] >= 0
        counts.append((high - low) // step + 1 if step else 1)
        starts.append(low if rising else high)
        steps.append(step if rising else -step)
        axes.append(v * steps[-1])
    sizes = [np.hypot(*v) for v in axes]
    angle = math.atan2(axes[0][1], axes[0][0]) if sizes[0] else math.atan2(axes[1][1], axes[1][0]) - math.pi / 2
    if not sizes[0] or not sizes[1]:  # one line: its cells are as wide as long
        side = max(sizes)
        axes = [a if s else side * np.array([math.cos(angle + k * math.pi / 2), math.sin(angle + k * math.pi / 2)]) for k, (a, s) in enumerate(zip(axes, sizes, strict=True))]
        sizes = [side, side]
    at = dict(zip((first, 1 - first), zip(starts, steps, strict=True), strict=True))
    corner = np.array([ref.x, ref.y]) + (at[0][0] - ref.il) * il + (at[1][0] - ref.xl) * xl - (axes[0] + axes[1]) / 2
    inverse = np.linalg.pinv(np.stack([il, xl], axis=1))
    base = np.array([ref.il, ref.xl]) - inverse @ (np.array([ref.x, ref.y]) - corner)
    return Geometry(*corner.tolist(), sizes[0], sizes[1], *counts, angle, *base.tolist(), *inverse.ravel().tolist(), at[0][0], at[1][0], at[0][1] or 1, at[1][1] or 1, first == 0, (tuple(il.tolist()), tuple(xl.tolist())), (ref.x, ref.y, ref.il, ref.xl))
