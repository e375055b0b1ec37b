"""Padding of grids: which cell fills a padded place, how far it is from the data, and how long an axis becomes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mirror_index(i: Column, n: Column, padded: Column) -> Column:
    """The cell (0 to n - 1) that fills place `i` of an axis of `padded` places; null beyond it.

    The data are mirrored at the nearer end, no further than to their middle."""
    past, before = i - n + 1, padded - i - 1
    middle = F.floor(n / 2).cast("long")
    return F.when(i < n, i).when(i < padded, F.when(past < before, F.greatest(n - past, middle)).otherwise(F.least(before, middle))).cast("long")


def boundary_distance(i: Column, n: Column, padded: Column) -> Column:
    """0 in the data, then the distance to their nearer end in units of the taper's length; null beyond the axis."""
    taper = F.least(n, padded - n) / 2.1
    return F.when(i < n, 0.0).when(i < padded, F.try_divide(F.least(i - n + 1, padded - i), taper))


def padding_share(first: Column, second: Column, step: Column, length: Column) -> Column:
    """Share of `length` to pad: half the longer reach of the lateral correlation, a cell at least, the whole length at most."""
    return F.least(F.lit(1.0), F.greatest(0.5 * F.greatest(F.abs(first), F.abs(second)), step) / length)


def smooth_numbers(most: int) -> list[int]:
    """All products of 2, 3, 5 and 7 up to `most`, in order."""
    found = {1}
    for p in (2, 3, 5, 7):
        for v in sorted(found):
            while (v := v * p) <= most:
                found.add(v)
    return sorted(found)


def padded_size(n: Column, share: Column, most: int) -> Column:
    """Shortest axis of at least n (1 + share) cells that transforms fast; null beyond `most`."""
    table = F.array(*[F.lit(v) for v in smooth_numbers(most)])
    return F.array_min(F.filter(table, lambda v: v >= F.ceil(n * (1 + share)))).cast("long")
