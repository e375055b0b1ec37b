"""Well logs: cleaning, blocking, trends and correlations along a well. A log is a row a sample; null means missing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Samples that are merged in one group of rows, about.
FOLDED = 20_000


def block_logs(samples: DataFrame, keys: list[str], block: str, values: list[str], facies: str | None = None) -> DataFrame:
    """One row a block: n, ln_<value> (mean of the logarithms of what is there), and the most frequent facies.

    Of n tied facies, in ascending order, number (block + 1) mod n is taken. Partial sums are shuffled; a block of a hot
    well is one small row a task and facies."""
    by = [*keys, block]
    means = [F.avg(F.when(F.col(v) > 0, F.ln(v))).alias(f"ln_{v}") for v in values]
    blocks = samples.groupBy(*by).agg(F.count("*").alias("n"), *means)
    if facies is None:
        return blocks
    counts = samples.where(F.col(facies).isNotNull()).groupBy(*by, facies).agg(F.count("*").alias("_n"))
    best = counts.groupBy(*by).agg(F.max(F.struct("_n")).alias("_top"), F.collect_list(F.struct("_n", F.col(facies).alias("f"))).alias("_all"))
    tied = F.array_sort(F.transform(F.filter("_all", lambda x: x["_n"] == F.col("_top._n")), lambda x: x["f"]))
    best = best.select(*by, F.element_at(tied, (F.pmod(F.col(block) + 1, F.size(tied)) + 1).cast("int")).alias(facies), F.size(tied).alias("n_tied"))
    return blocks.join(best, by, "left")


def vertical_trend(blocks: DataFrame, layer: str, values: list[str]) -> DataFrame:
    """Mean over all wells of the blocks of each layer."""
    return blocks.groupBy(layer).agg(F.count("*").alias("n_blocks"), *[F.avg(v).alias(v) for v in values])


def fill_gaps(samples: DataFrame, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    """Holes filled linearly by the sample's place in the well (not its depth); those at the ends stay."""
    w = Window.partitionBy(*keys).orderBy(order)
    place = F.row_number().over(w)
    rows = samples.withColumn("_at", place)
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col("_at").alias("at"), F.col(value).alias("v")))
    rows = rows.withColumn("_a", F.last(known, ignorenulls=True).over(before)).withColumn("_b", F.first(known, ignorenulls=True).over(after))
    between = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * F.try_divide(F.col("_at") - F.col("_a.at"), F.col("_b.at") - F.col("_a.at"))
    return rows.withColumn(out, F.coalesce(F.col(value), between)).drop("_at", "_a", "_b")


def longest_run(samples: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """(keys, start, length) of the longest run of samples that have a value; the first of equal ones; places count from 0. Without data: (0, 0)."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = samples.select(*keys, (F.row_number().over(w) - 1).alias("_at"), F.col(value).isNotNull().alias("_has"))
    inside = rows.where("_has").withColumn("_run", F.col("_at") - F.row_number().over(Window.partitionBy(*keys).orderBy("_at")))
    runs = inside.groupBy(*keys, "_run").agg(F.min("_at").alias("start"), F.count("*").alias("length"))
    best = runs.groupBy(*keys).agg(F.max_by(F.struct("start", "length"), F.struct("length", -F.col("start"))).alias("r"))
    zero = F.lit(0).cast("long")
    return samples.select(*keys).distinct().join(best, keys, "left").select(*keys, F.coalesce("r.start", zero).alias("start"), F.coalesce("r.length", zero).alias("length"))


def largest_slope(samples: DataFrame, keys: list[str], order: str, x: str, y: str, z: str) -> DataFrame:
    """Largest deviation angle, in degrees, between neighbouring samples of each well."""
    w = Window.partitionBy(*keys).orderBy(order)
    step = lambda c: F.col(c) - F.lag(c).over(w)
    angle = F.degrees(F.atan2(F.sqrt(F.pow(step(x), 2) + F.pow(step(y), 2)), F.abs(step(z))))
    return samples.select(*keys, angle.alias("_angle")).groupBy(*keys).agg(F.max("_angle").alias("max_angle"))


def rank_correlation(samples: DataFrame, keys: list[str], a: str, b: str, order: str) -> DataFrame:
    """(keys, n, rank_correlation, synthetic) of two logs in each well, over samples that have both.

    Ranks are distinct and count from 0 (ties in `order`); their products are taken about n / 2. A log of which more than
    0.99 follows from the other is flagged as synthetic."""
    both = samples.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    rank = lambda c: F.row_number().over(Window.partitionBy(*keys).orderBy(c, order)) - 1
    ranks = both.select(*keys, (rank(a) - F.count("*").over(Window.partitionBy(*keys)) / 2).alias("_a"), (rank(b) - F.count("*").over(Window.partitionBy(*keys)) / 2).alias("_b"))
    found = ranks.groupBy(*keys).agg(F.count("*").alias("n"), (F.sum(F.col("_a") * F.col("_b")) / F.sum(F.col("_a") * F.col("_a"))).alias("rank_correlation"))
    return found.withColumn("synthetic", F.col("rank_correlation") > 0.99)


def lag_covariance(blocks: DataFrame, keys: list[str], layer: str, a: str, b: str, lags: int) -> DataFrame:
    """Covariance of a at one layer with b `lag` layers below, over all wells, for lags 0 to `lags`.

    Each block is sent to the lags + 1 layers that it meets: an equi-join on (well, layer), not all pairs."""
    means = blocks.agg(F.avg(a).alias("_ma"), F.avg(b).alias("_mb"))
    left = blocks.select(*keys, F.col(layer).alias("_k"), F.col(a).alias("_a"), F.explode(F.sequence(F.lit(0), F.lit(lags))).alias("lag")).withColumn("_at", F.col("_k") + F.col("lag"))
    right = blocks.select(*keys, F.col(layer).alias("_at"), F.col(b).alias("_b"))
    pairs = left.join(right, [*keys, "_at"]).where("_a IS NOT NULL AND _b IS NOT NULL").crossJoin(F.broadcast(means))
    return pairs.groupBy("lag").agg(F.count("*").alias("n"), F.avg((F.col("_a") - F.col("_ma")) * (F.col("_b") - F.col("_mb"))).alias("covariance"))


def merge_near_duplicates(samples: DataFrame, keys: list[str], z: str, values: list[str], distance: float = 0.01, bin_: float = 1000.0) -> DataFrame:
    """Samples within `distance` of a group's first sample are one: mean of z and of the values that are there.

    A group is anchored at its start, so a chain of small steps doesn't extend it; that is a fold. A gap of `distance` or
    more always begins a group, so a well is cut there first, and the fold runs over the pieces that begin in one bin of
    `bin_` distances. Gaps are found in bins too, and across bins from their ends only, so that a long well is many tasks. Returns keys, group
    (from 0 in each well), n, z and the values; samples without z are left out."""
    rows = samples.where(F.col(z).isNotNull()).select(*keys, F.col(z).cast("double").alias(z), *values).withColumn("_bin", F.floor(F.col(z) / (bin_ * distance)))
    ends = rows.groupBy(*keys, "_bin").agg(F.max(z).alias("_end"))
    by_bin = Window.partitionBy(*keys).orderBy("_bin")
    ends = ends.select(*keys, "_bin", F.lag("_end").over(by_bin).alias("_before"))
    within = Window.partitionBy(*keys, "_bin").orderBy(z)
    # A piece is named by the z it begins at; a bin that begins inside one inherits it.
    rows = rows.join(ends, [*keys, "_bin"]).withColumn("_last", F.coalesce(F.lag(z).over(within), F.col("_before")))
    rows = rows.withColumn("_start", F.when(F.col("_last").isNull() | (F.col(z) - F.col("_last") >= distance), F.col(z)))
    rows = rows.withColumn("_start", F.last("_start", ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    passed = rows.groupBy(*keys, "_bin").agg(F.max("_start").alias("_s")).withColumn("_s", F.last("_s", ignorenulls=True).over(by_bin.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.join(passed, [*keys, "_bin"]).withColumn("_home", F.floor(F.coalesce("_start", "_s") / (bin_ * distance)))

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        """The pieces that begin in some bins; the first sample of a piece always begins a group."""
        pdf = pdf.assign(_own=pdf.groupby([*keys, "_home"], dropna=False, sort=False).ngroup()).sort_values(["_own", z, *values], kind="stable")
        at, own, begins, i = pdf[z].to_numpy(), pdf["_own"].to_numpy(), [], 0
        ends = np.searchsorted(own, own, side="right")
        while i < len(at):
            begins.append(i)
            i += max(int(np.searchsorted(at[i : ends[i]], at[i] + distance, "left")), 1)
        new = np.concatenate([[True], own[begins][1:] != own[begins][:-1]])
        group = np.arange(len(begins))
        out = {k: pdf[k].iloc[begins].array for k in [*keys, "_home"]} | {"group": group - np.maximum.accumulate(np.where(new, group, 0)), "n": np.diff([*begins, len(at)])}
        for c in (z, *values):
            x = pdf[c].to_numpy(float, na_value=np.nan)
            known = np.add.reduceat(~np.isnan(x), begins, dtype=np.int64)
            out[c] = np.where(known > 0, np.add.reduceat(np.nan_to_num(x), begins) / np.maximum(known, 1), np.nan)
        return pd.DataFrame(out)

    schema = T.StructType([*[samples.schema[k] for k in keys], T.StructField("_home", T.LongType()), T.StructField("group", T.LongType()), T.StructField("n", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in (z, *values)]])
    # Many bins to a task's group, whatever the wells; a bin is whole in one of them.
    parts = max(1, samples.count() // FOLDED)
    found = rows.select(*keys, "_home", z, *values).groupBy(F.pmod(F.xxhash64(*keys, "_home"), F.lit(parts))).applyInPandas(merged, schema)
    found = found.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in values})
    earlier = found.groupBy(*keys, "_home").agg(F.max("group").alias("_n"))
    earlier = earlier.select(*keys, "_home", F.coalesce(F.sum(F.col("_n") + 1).over(Window.partitionBy(*keys).orderBy("_home").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"))
    return found.join(earlier, [*keys, "_home"]).select(*keys, (F.col("_first") + F.col("group")).alias("group"), "n", z, *values)


def high_cut(traces: DataFrame, value: str, out: str, dt_ms: float, max_hz: float) -> DataFrame:
    """Low-pass of array traces: mirrored to twice the length, transformed, cut above `max_hz`, transformed back."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = []
            for trace in pdf[value]:
                x = np.asarray(trace, float)
                n = len(x)
                spectrum = np.fft.rfft(np.concatenate([x, x[::-1]]))
                spectrum[int(max_hz * (2 * n - 1) * dt_ms / 1000 + 0.5) + 1 :] = 0
                done.append(np.fft.irfft(spectrum, 2 * n)[:n].tolist() if n else [])
            yield pdf.assign(**{out: done})

    schema = T.StructType([*traces.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])
    return traces.mapInPandas(cut, schema)


def reflections(rows: DataFrame, keys: list[str], layer: str | list[str], value: Column, out: str) -> DataFrame:
    """Backward difference along each trace; 0 at its top. Layers that tie need a further column in `layer` to settle their order."""
    w = Window.partitionBy(*keys).orderBy(layer)
    return rows.withColumn("_v", value).withColumn(out, F.coalesce(F.col("_v") - F.lag("_v").over(w), F.lit(0.0))).drop("_v")


def convolve(rows: DataFrame, keys: list[str], layer: str | list[str], value: str, wavelet: list[float], out: str) -> DataFrame:
    """Synthetic trace: the reflections convolved with a wavelet of odd length, its middle at lag 0; layers are dense."""
    w, half = Window.partitionBy(*keys).orderBy(layer), len(wavelet) // 2
    terms = [weight * F.coalesce(F.lag(value, k - half).over(w), F.lit(0.0)) for k, weight in enumerate(wavelet)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return rows.withColumn(out, total)
