"""Facies probabilities: counts, histograms, posteriors, conditional tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prior_probability(blocks: DataFrame, facies: str) -> DataFrame:
    counts = blocks.where(F.col(facies).isNotNull()).groupBy(facies).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("_all")))).select(facies, "n", (F.col("n") / F.col("_all")).alias("prior"))


def histogram(samples: DataFrame, facies: str, value: Column, low: float, high: float, bins: int) -> DataFrame:
    """Density of a value by facies and bin (1 to bins; values outside are left out)."""
    bin_ = F.width_bucket(value, F.lit(low), F.lit(high), F.lit(bins))
    rows = samples.select(facies, bin_.alias("bin")).where(F.col("bin").between(1, bins))
    counts = rows.groupBy(facies, "bin").agg(F.count("*").alias("n"))
    totals = counts.groupBy(facies).agg(F.sum("n").alias("_all"))
    return counts.join(F.broadcast(totals), facies).select(facies, "bin", "n", (F.col("n") / F.col("_all") * bins / (high - low)).alias("density"))


def posterior(density: DataFrame, prior: DataFrame, facies: str, undefined: float, volume: float) -> DataFrame:
    """Probability of each facies in each bin: prior x density over their sum and an undefined share of the volume."""
    weighted = density.join(F.broadcast(prior.select(facies, "prior")), facies).withColumn("_w", F.col("prior") * F.col("density"))
    totals = weighted.groupBy("bin").agg(F.sum("_w").alias("_sum"))
    u = undefined / volume
    return weighted.join(F.broadcast(totals), "bin").select("bin", facies, (F.col("_w") / (F.col("_sum") + u)).alias("probability"), (u / (F.col("_sum") + u)).alias("undefined"))


def conditional_table(blocks: DataFrame, facies: str, probabilities: dict[str, str]) -> DataFrame:
    """Mean probability of each facies over blocks whose log has each facies."""
    return blocks.where(F.col(facies).isNotNull()).groupBy(facies).agg(F.count("*").alias("n"), *[F.avg(c).alias(name) for name, c in probabilities.items()])
