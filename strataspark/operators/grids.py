"""Grids and surfaces: places in a rotated box, zones, statistics, priors, comparisons."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell_index(x: Column, y: Column, z: Column, top: Column, base: Column, x0: float, y0: float, dx: float, dy: float, nx: int, ny: int, nz: int, angle: float = 0.0) -> Column:
    """Struct (i, j, k) of the cell of a point in a box turned by `angle`, or null outside.

    The far lateral edges belong to the last cell; z must lie strictly between top and base."""
    c, s = math.cos(angle), math.sin(angle)
    rx, ry = c * (x - x0) + s * (y - y0), c * (y - y0) - s * (x - x0)
    inside = rx.between(0, nx * dx) & ry.between(0, ny * dy) & (z > top) & (z < base)
    last = lambda v, n: F.least(F.floor(v), F.lit(n - 1)).cast("long")
    depth = nz * F.try_divide(z - top, base - top)
    return F.when(inside, F.struct(last(rx / dx, nx).alias("i"), last(ry / dy, ny).alias("j"), last(depth, nz).alias("k")))


def zone_of(points: DataFrame, zones: DataFrame, z: str = "z") -> DataFrame:
    """`points` with the first zone (zone, top, base; a bounded table) whose surfaces bracket z; null if none."""
    held = zones.agg(F.array_sort(F.collect_list(F.struct("zone", "top", "base"))).alias("_zones"))
    hit = F.filter("_zones", lambda s: (F.col(z) >= s["top"]) & (F.col(z) < s["base"]))
    return points.crossJoin(F.broadcast(held)).withColumn("zone", F.try_element_at(hit, F.lit(1))["zone"]).drop("_zones")


def eroded(surfaces: DataFrame, keys: list[str], number: str, priority: str, z: str) -> DataFrame:
    """Surfaces (few at each place) where one of lower priority never crosses one of higher: it is clamped to it.

    A surface above one of higher priority (smaller number) may not lie below it, and the other way round."""
    all_ = surfaces.groupBy(*keys).agg(F.collect_list(F.struct(F.col(number).alias("n"), F.col(priority).alias("p"), F.col(z).alias("z"))).alias("_s"))
    rows = surfaces.join(all_, keys)
    above = F.array_max(F.transform(F.filter("_s", lambda s: (s["n"] < F.col(number)) & (s["p"] < F.col(priority))), lambda s: s["z"]))
    below = F.array_min(F.transform(F.filter("_s", lambda s: (s["n"] > F.col(number)) & (s["p"] < F.col(priority))), lambda s: s["z"]))
    clamped = F.least(F.greatest(F.col(z), F.coalesce(above, F.col(z))), F.coalesce(below, F.greatest(F.col(z), F.coalesce(above, F.col(z)))))
    return rows.withColumn(f"{z}_eroded", clamped).drop("_s")


def statistics(cells: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """n, n_missing, min, max, mean, and mean square over cells that are not 0."""
    v = F.col(value)
    return cells.groupBy(*(by or [])).agg(
        F.count(v).alias("n"), F.count_if(v.isNull()).alias("n_missing"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.avg(v).alias("mean"), F.avg(F.when(v != 0, v * v)).alias("data_variance"),
    )


def missing_to_mean(cells: DataFrame, value: str, out: str) -> DataFrame:
    mean = cells.agg(F.avg(value).alias("_mean"))
    return cells.crossJoin(F.broadcast(mean)).withColumn(out, F.coalesce(F.col(value), F.col("_mean"))).drop("_mean")


def normalised_priors(values: list[Column]) -> list[Column]:
    """Prior probabilities of facies: missing and negative ones are 0, and all are divided by their sum (null if that is 0)."""
    clean = [F.greatest(F.coalesce(v, F.lit(0.0)), F.lit(0.0)) for v in values]
    total = clean[0]
    for c in clean[1:]:
        total = total + c
    return [F.try_divide(c, total) for c in clean]


def compared(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Golden comparison of two grids on absolute values: n, max_abs_diff, mean_abs_diff, mean_diff, mean_value."""
    pair = a.select(*keys, F.abs(value).alias("_a")).join(b.select(*keys, F.abs(value).alias("_b")), keys)
    d = F.col("_a") - F.col("_b")
    return pair.agg(F.count("*").alias("n"), F.max(F.abs(d)).alias("max_abs_diff"), F.avg(F.abs(d)).alias("mean_abs_diff"), F.avg(d).alias("mean_diff"), F.avg("_a").alias("mean_value"))


def bilinear(surface: DataFrame, points: DataFrame, x0: float, y0: float, dx: float, dy: float) -> DataFrame:
    """`points` (x, y) with z of the surface (i, j, z) between its four nodes; null where one is missing.

    Each point meets its four nodes by an equi-join on (i, j)."""
    u, v = (F.col("x") - x0) / dx, (F.col("y") - y0) / dy
    rows = points.withColumn("_id", F.monotonically_increasing_id()).withColumn("_u", u - F.floor(u)).withColumn("_v", v - F.floor(v))
    corners = F.array(*[F.struct((F.floor(u) + a).alias("i"), (F.floor(v) + b).alias("j"), ((F.col("_u") if a else 1 - F.col("_u")) * (F.col("_v") if b else 1 - F.col("_v"))).alias("w")) for a in (0, 1) for b in (0, 1)])
    each = rows.withColumn("_c", F.explode(F.filter(corners, lambda c: c["w"] > 0))).withColumn("i", F.col("_c.i")).withColumn("j", F.col("_c.j"))
    joined = each.join(surface.select(F.col("i").cast("long"), F.col("j").cast("long"), "z"), ["i", "j"], "left")
    z = F.when(F.count("z") == F.count("*"), F.sum(F.col("_c.w") * F.col("z")))
    return joined.groupBy("_id", *points.columns).agg(z.alias("z")).drop("_id")


def trilinear(cells: DataFrame, points: DataFrame, low: tuple[float, float, float], size: tuple[float, float, float], n: tuple[int, int, int], out: str = "value") -> DataFrame:
    """`points` (x, y, z) with the value of the cube (i, j, k, value) between the centres of eight cells.

    The box begins at `low` and has n cells of `size`; points outside are null. Cells that lack, lie outside the box or are
    negative count as 0, as the cube holds quantities that can't be negative. Each point meets its cells by an equi-join."""
    at = [(F.col(c) - lo) / s - 0.5 for c, lo, s in zip("xyz", low, size, strict=True)]
    inside = (F.col("x").between(low[0], low[0] + n[0] * size[0])) & (F.col("y").between(low[1], low[1] + n[1] * size[1])) & (F.col("z").between(low[2], low[2] + n[2] * size[2]))
    rows = points.withColumn("_id", F.monotonically_increasing_id()).withColumn("_in", F.coalesce(inside, F.lit(False)))
    for c, v in zip("ijk", at, strict=True):
        rows = rows.withColumn(f"_{c}", F.floor(v).cast("long")).withColumn(f"_w{c}", v - F.floor(v))
    corners = F.array(*[F.struct(*[(F.col(f"_{c}") + d).alias(c) for c, d in zip("ijk", step, strict=True)], _weight(step).alias("w")) for step in ((a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1))])
    each = rows.withColumn("_c", F.explode(corners)).select("_id", "_in", *points.columns, *[F.col(f"_c.{c}").alias(f"_{c}") for c in "ijkw"])
    held = cells.select(*[F.col(c).cast("long").alias(f"_{c}") for c in "ijk"], F.greatest(F.col("value"), F.lit(0.0)).alias("_v")).where(F.col("_i").between(0, n[0] - 1) & F.col("_j").between(0, n[1] - 1) & F.col("_k").between(0, n[2] - 1))
    joined = each.join(held, ["_i", "_j", "_k"], "left")
    total = F.when(F.col("_in"), F.sum(F.col("_w") * F.coalesce("_v", F.lit(0.0))))
    return joined.groupBy("_id", "_in", *points.columns).agg(total.alias(out)).drop("_id", "_in")


def _weight(step: tuple[int, int, int]) -> Column:
    found = F.lit(1.0)
    for c, d in zip("ijk", step, strict=True):
        found = found * (F.col(f"_w{c}") if d else 1 - F.col(f"_w{c}"))
    return found


def arithmetic(a: DataFrame, b: DataFrame, cell: list[str], value: str, how: str) -> DataFrame:
    """(cell, value) of `a` and `b` added, subtracted or multiplied cell by cell; null where either has none. Cells of one grid alone are not there."""
    both = a.select(*cell, F.col(value).alias("_a")).join(b.select(*cell, F.col(value).alias("_b")), cell)
    x, y = F.col("_a"), F.col("_b")
    return both.select(*cell, {"add": x + y, "subtract": x - y, "multiply": x * y}[how].alias(value))
