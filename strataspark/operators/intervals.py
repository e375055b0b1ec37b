"""Interval grids: surfaces eroded by priority, visible parts, boxes of intervals, and wells blocked in their layers.

Surfaces stand side by side, one column each from the top down, a row a place: erosion and visibility then need no shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def eroded_in_order(columns: DataFrame, surfaces: list[str], priorities: list[int], suffix: str = "_eroded") -> DataFrame:
    """`columns` with each surface eroded, as <surface><suffix>; priorities are 1 to the number of surfaces, each once.

    In order of priority a surface is cut by the nearest one done below it, then by the nearest one done above it, so that
    one of lower priority never crosses one of higher. Where either is null, nothing is cut."""
    if sorted(priorities) != list(range(1, len(surfaces) + 1)):
        raise ValueError("erosion priorities are 1 to the number of surfaces, each once")
    done: set[int] = set()
    for n in sorted(range(len(surfaces)), key=lambda k: priorities[k]):
        z = F.col(surfaces[n])
        below, above = min((k for k in done if k > n), default=None), max((k for k in done if k < n), default=None)
        if below is not None:
            other = F.col(surfaces[below] + suffix)
            z = F.when(z > other, other).otherwise(z)
        if above is not None:
            other = F.col(surfaces[above] + suffix)
            z = F.when(z < other, other).otherwise(z)
        columns = columns.withColumn(surfaces[n] + suffix, z)
        done.add(n)
    return columns


def visible(surfaces: list[str], suffix: str = "_eroded") -> list[tuple[Column, Column]]:
    """Top and base of each interval between eroded surfaces, kept within the interval's own surfaces before erosion."""
    found = []
    for above, below in zip(surfaces, surfaces[1:], strict=False):
        a, b = F.col(above), F.col(below)
        found.append(tuple(F.when(F.col(c + suffix) < a, a).when(F.col(c + suffix) > b, b).otherwise(F.col(c + suffix)) for c in (above, below)))
    return found


def interval_boxes(columns: DataFrame, names: list[str], spans: list[tuple[Column, Column]], layers: list[int], limit: float = 0.0, desired: list[float] | None = None) -> DataFrame:
    """(number, interval, n_layers, first_layer, n_places, lz, min_relative, dz, dz_relative, resolution, status), a row an interval.

    `lz` is the largest thickness, `dz` its share of a layer, `dz_relative` that over the finest of the intervals, `resolution`
    over the `desired` step. `status` is ok, crossing (base above top somewhere), thin (below `limit` of the largest), or
    empty (no place has both surfaces, or none has any thickness); only intervals that are ok count for the finest step.
    One aggregate over all places, of three numbers an interval."""
    thick = [base - top for top, base in spans]
    held = columns.agg(*[f(t).alias(f"{n}{k}") for k, t in enumerate(thick) for n, f in (("lo", F.min), ("hi", F.max), ("n", F.count))])
    desired = desired or [None] * len(names)
    starts = [sum(layers[:k]) for k in range(len(layers))]
    each = [F.struct(F.lit(k).alias("number"), F.lit(names[k]).alias("interval"), F.lit(layers[k]).alias("n_layers"), F.lit(starts[k]).alias("first_layer"), F.col(f"n{k}").alias("n_places"),
                     F.col(f"hi{k}").cast("double").alias("lz"), F.col(f"lo{k}").cast("double").alias("lo"), F.lit(desired[k]).cast("double").alias("desired")) for k in range(len(names))]
    rows = held.select(F.inline(F.array(*each)))
    relative = F.try_divide(F.col("lo"), F.col("lz"))
    status = F.when(F.col("lz").isNull(), "empty").when(F.col("lo") < 0, "crossing").when(F.col("lz") == 0, "empty").when(relative < limit, "thin").otherwise("ok")
    rows = rows.select("*", relative.alias("min_relative"), (F.col("lz") / F.col("n_layers")).alias("dz"), status.alias("status"))
    finest = F.min(F.when(F.col("status") == "ok", F.col("dz"))).over(Window.partitionBy())  # as many rows as intervals
    ratio = F.when(F.col("status") == "ok", F.col("dz") / finest)
    return rows.select("number", "interval", "n_layers", "first_layer", "n_places", "lz", "min_relative", "dz", ratio.alias("dz_relative"), F.try_divide("dz", "desired").alias("resolution"), "status")


def layer_of(z: Column, spans: list[tuple[Column, Column]], layers: list[int]) -> Column:
    """Struct (interval, layer, total) of the first interval whose span holds z (top inclusive, base exclusive), or null.

    `layer` counts from the interval's top in equal parts of its thickness at the place, `total` from the top of all."""
    cases, start = [], 0
    for k, ((top, base), n) in enumerate(zip(spans, layers, strict=True)):
        layer = F.least(F.floor(n * (z - top) / (base - top)), F.lit(n - 1)).cast("int")
        cases.append(F.when((top <= z) & (z < base), F.struct(F.lit(k).alias("interval"), layer.alias("layer"), (layer + start).alias("total"))))
        start += n
    return F.coalesce(*cases)


def extended(columns: DataFrame, top: str, base: str, correlation: str) -> DataFrame:
    """`columns` with (top_extended, base_extended): two surfaces parallel to `correlation` that hold the whole interval.

    They touch it at one place or more. Rows without one of the three surfaces don't take part and get nulls."""
    c = F.col(correlation)
    every = F.col(top).isNotNull() & F.col(base).isNotNull() & c.isNotNull()
    shift = columns.where(every).agg(F.min(F.col(top) - c).alias("_up"), F.max(F.col(base) - c).alias("_down"))
    rows = columns.crossJoin(F.broadcast(shift))
    return rows.withColumn("top_extended", F.when(every, c + F.col("_up"))).withColumn("base_extended", F.when(every, c + F.col("_down"))).drop("_up", "_down")


def blocks_along(samples: DataFrame, well: str, order: str, cell: list[str], total: str, stretch: int = 1 << 16) -> DataFrame:
    """`samples` with `block` (long): a well's first cell has its `total` layer, each cell met for the first time the next number.

    A sample that turns back into an earlier cell counts to the block that is open, so that a well that swings between two
    cells makes no further blocks; one without a cell (null) has none. `order` is an integer that is unique in a well.

    No task gets a whole well: cells are found by one aggregate, then counted within stretches of `stretch` numbers of
    `order` and over the stretches, which are few."""
    rows = samples.withColumn("_s", F.floor(F.col(order) / stretch))
    inside = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cell])
    met = rows.where(inside).groupBy(well, *cell).agg(F.min(F.struct(F.col(order), F.col(total))).alias("_m"))
    opened = met.select(well, F.col(f"_m.{order}").alias(order), F.col(f"_m.{total}").alias("_total"))
    stretches = opened.groupBy(well, F.floor(F.col(order) / stretch).alias("_s")).agg(F.count("*").alias("_n"), F.min(F.struct(order, "_total")).alias("_f"))
    every = rows.select(well, "_s").distinct().join(stretches, [well, "_s"], "left")
    over = Window.partitionBy(well)
    before = F.coalesce(F.sum("_n").over(over.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = every.select(well, "_s", before.alias("_before"), F.min("_f").over(over)["_total"].alias("_first"))
    marked = rows.join(opened.select(well, order, F.lit(1).alias("_o")), [well, order], "left").join(starts, [well, "_s"])
    within = F.count("_o").over(Window.partitionBy(well, "_s").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("block", F.when(inside, F.col("_first") + F.col("_before") + within - 1).cast("long")).drop("_s", "_o", "_before", "_first")


def numbered(rows: DataFrame, key: str, order: str, out: str = "seq", stretch: int = 1 << 16) -> DataFrame:
    """`rows` with `out` (long), their place from 0 within `key` by `order`, an integer that is unique there; by stretches, as `blocks_along`."""
    rows = rows.withColumn("_s", F.floor(F.col(order) / stretch))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = rows.groupBy(key, "_s").agg(F.count("*").alias("_n")).select(key, "_s", before.alias("_before"))
    within = F.row_number().over(Window.partitionBy(key, "_s").orderBy(order)) - 1
    return rows.join(starts, [key, "_s"]).withColumn(out, (F.col("_before") + within).cast("long")).drop("_s", "_before")


def interval_blocks(samples: DataFrame, well: str, order: str, cell: list[str], places: list[str], means: list[str], logarithmic: list[str]) -> DataFrame:
    """A row a well and block of `blocks_along`: n, its cell (of the first sample), the means of `places` (coordinates), of
    `means` (as porosity, over the samples that have it) and of the logarithms of `logarithmic` (as ln_<log>)."""
    averages = [F.avg(c).alias(c) for c in places + means] + [F.avg(F.ln(F.when(F.col(c) > 0, F.col(c)))).alias(f"ln_{c}") for c in logarithmic]
    rows = samples.where("block IS NOT NULL").groupBy(well, "block").agg(F.count("*").alias("n"), F.min_by(F.struct(*cell), order).alias("_c"), *averages)
    return rows.select(well, "block", "n", *[F.col(f"_c.{c}").alias(c) for c in cell], *places, *means, *[f"ln_{c}" for c in logarithmic])


def well_extents(samples: DataFrame, well: str, order: str, interval: str, layer: str, layers: list[int]) -> DataFrame:
    """(well, first_interval, last_interval, first_layer, last_layer, n_defined, n_blocks) of wells in `blocks_along`.

    `n_blocks` adds to the blocks that the well meets the layers above its first and below its last sample."""
    at = F.struct(F.col(interval).alias("i"), F.col(layer).alias("k"))
    rows = samples.where("block IS NOT NULL").groupBy(well).agg(F.min_by(at, order).alias("a"), F.max_by(at, order).alias("b"), (F.max("block") - F.min("block") + 1).alias("n_defined"))
    start = F.array(*[F.lit(sum(layers[:k])) for k in range(len(layers))])
    above, below = F.get(start, F.col("a.i")) + F.col("a.k"), sum(layers) - F.get(start, F.col("b.i")) - F.col("b.k") - 1
    return rows.select(well, F.col("a.i").alias("first_interval"), F.col("b.i").alias("last_interval"), F.col("a.k").alias("first_layer"), F.col("b.k").alias("last_layer"), "n_defined", (above + F.col("n_defined") + below).alias("n_blocks"))
