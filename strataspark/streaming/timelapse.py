"""Time-lapse updates: a Gaussian state for each cell, refined by every vintage that arrives.

The update of a static Gaussian state adds precisions, so any number of vintages in any order is one sum: the same
function serves a batch and a stream (complete or update mode), and the state kept for a cell is two numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def updated_state(observations: DataFrame, cell: list[str], value: str, variance: str, prior_mean: float, prior_variance: float) -> DataFrame:
    """(cell, n, mean, variance) after all observations; those without value or with no positive variance don't count."""
    ok = F.col(value).isNotNull() & (F.col(variance) > 0)
    weight = F.when(ok, 1 / F.col(variance)).otherwise(0.0)
    sums = observations.groupBy(*cell).agg(F.count_if(ok).alias("n"), F.sum(weight).alias("_w"), F.sum(F.when(ok, weight * F.col(value)).otherwise(0.0)).alias("_s"))
    precision = 1 / prior_variance + F.col("_w")
    return sums.select(*cell, "n", ((prior_mean / prior_variance + F.col("_s")) / precision).alias("mean"), (1 / precision).alias("variance"))
