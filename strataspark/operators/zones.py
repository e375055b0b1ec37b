"""Intervals, areas and volumes: merging by priority, thickness, depth, coverage, gravity, mixtures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def combined(parts: list[DataFrame], cell: list[str], value: str) -> DataFrame:
    """One grid from several that overlap: each cell takes the value of the first part that has one."""
    rows = [p.select(*cell, F.col(value), F.lit(k).alias("_rank")) for k, p in enumerate(parts)]
    every = reduce(DataFrame.unionByName, rows).where(F.col(value).isNotNull())
    return every.groupBy(*cell).agg(F.min_by(value, "_rank").alias(value), F.min("_rank").alias("part"), F.count("*").alias("n_parts"))


def shared_area(points: DataFrame, source: str, x: str, y: str) -> DataFrame:
    """The rectangle that the areas of all sources have in common; `empty` if there is none."""
    each = points.groupBy(source).agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    out = each.agg(F.max("x0").alias("x0"), F.min("x1").alias("x1"), F.max("y0").alias("y0"), F.min("y1").alias("y1"))
    return out.withColumn("empty", (F.col("x0") > F.col("x1")) | (F.col("y0") > F.col("y1")))


def names_compared(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    """(name, in_a, in_b): which of two sources know each name, as of facies in wells and in prior cubes."""
    left = a.select(name).distinct().withColumn("_a", F.lit(True))
    right = b.select(name).distinct().withColumn("_b", F.lit(True))
    return left.join(right, name, "full").select(name, F.col("_a").isNotNull().alias("in_a"), F.col("_b").isNotNull().alias("in_b"))


def thickness(columns: DataFrame, top: str, base: str, layers: int, limit: float = 0.41) -> DataFrame:
    """Smallest thickness, largest layer, mean relative thickness, and columns thinner than `limit` of the thickest."""
    rows = columns.select((F.col(base) - F.col(top)).alias("_t")).where("_t IS NOT NULL")
    most = rows.agg(F.max("_t").alias("_most"))
    relative = F.try_divide(F.col("_t"), F.col("_most"))
    return rows.crossJoin(F.broadcast(most)).agg(
        F.min("_t").alias("min_thickness"), (F.max("_t") / layers).alias("dz"), F.avg(relative).alias("mean_relative"), F.count_if(relative < limit).alias("n_thin")
    )


def cell_centre(i: Column, j: Column, k: Column, top: Column, base: Column, x0: float, y0: float, dx: float, dy: float, nz: int, cos: float = 1.0, sin: float = 0.0) -> Column:
    """Struct (x, y, z) of the middle of a cell in a turned box."""
    u, v = (i + 0.5) * dx, (j + 0.5) * dy
    return F.struct((x0 + cos * u - sin * v).alias("x"), (y0 + sin * u + cos * v).alias("y"), (top + (k + 0.5) * (base - top) / nz).alias("z"))


def depths(layers: DataFrame, keys: list[str], order: list[str], velocity: str, dt_ms: str) -> DataFrame:
    """`layers` with the depth of each layer's base below the top of its column: summed velocity times half the two-way time."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return layers.withColumn("depth", F.sum(F.col(velocity) * F.col(dt_ms) / 2000).over(w))


def coverage(traces: DataFrame, first: str, last: str, top: str, base: str, guard: float) -> DataFrame:
    """How many traces don't reach from `guard` above the top to `guard` below the base, and the range that is needed."""
    need_top, need_base = F.col(top) - guard, F.col(base) + guard
    return traces.agg(F.count("*").alias("n"), F.count_if((F.col(first) > need_top) | (F.col(last) < need_base)).alias("n_short"), F.min(need_top).alias("from_z"), F.max(need_base).alias("to_z"))


def wells_inside(samples: DataFrame, well: str, inside: Column) -> DataFrame:
    """Wells with a sample inside the volume."""
    return samples.where(inside).select(well).distinct()


def gravity(observations: DataFrame, cells: DataFrame, key: str, weight: str) -> DataFrame:
    """Response at each observation (a bounded table): 500 times the cells' weight over their squared distance, summed.

    The observations are broadcast; the cells, which may be many, are summed where they are."""
    d2 = F.pow(F.col("x") - F.col("_x"), 2) + F.pow(F.col("y") - F.col("_y"), 2) + F.pow(F.col("z") - F.col("_z"), 2)
    places = observations.select(key, F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("z").alias("_z"))
    return cells.crossJoin(F.broadcast(places)).groupBy(key).agg(F.sum(F.try_divide(500 * F.col(weight), d2)).alias("response"))


def mixture(samples: DataFrame, facies: str, a: str, b: str) -> DataFrame:
    """Means and covariance of two parameters over facies: the mean of their covariances plus that of their means."""
    each = samples.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(facies).agg(F.count("*").alias("n"), F.avg(a).alias("a"), F.avg(b).alias("b"), F.covar_pop(a, b).alias("c"))
    total = each.agg(F.sum("n").alias("_n"), (F.sum(F.col("n") * F.col("a")) / F.sum("n")).alias("_a"), (F.sum(F.col("n") * F.col("b")) / F.sum("n")).alias("_b"))
    p = F.col("n") / F.col("_n")
    between = (F.col("a") - F.col("_a")) * (F.col("b") - F.col("_b"))
    return each.crossJoin(F.broadcast(total)).agg(F.first("_a").alias("mean_a"), F.first("_b").alias("mean_b"), F.sum(p * F.col("c")).alias("within"), F.sum(p * between).alias("between"))
