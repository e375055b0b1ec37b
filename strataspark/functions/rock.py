"""Rock physics, trends, tapers and survey dates, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days before each month of a year of 365 days.
DAYS_BEFORE = (0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334)


def moduli(vp: Column, vs: Column, rho: Column) -> tuple[Column, Column]:
    """Bulk and shear modulus."""
    return rho * (vp * vp - 4 / 3 * vs * vs), rho * vs * vs


def velocities(bulk: Column, shear: Column, rho: Column) -> tuple[Column, Column]:
    """vp and vs; null where a modulus makes no wave."""
    p, s = F.try_divide(bulk + 4 / 3 * shear, rho), F.try_divide(shear, rho)
    return F.when(p >= 0, F.sqrt(p)), F.when(s >= 0, F.sqrt(s))


def _total(terms: list[Column]) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def voigt(values: list[Column], fractions: list[Column]) -> Column:
    return _total([v * f for v, f in zip(values, fractions, strict=True)])


def reuss(values: list[Column], fractions: list[Column]) -> Column:
    """Harmonic mean; null where a part has no stiffness."""
    return F.try_divide(F.lit(1.0), _total([F.try_divide(f, v) for v, f in zip(values, fractions, strict=True)]))


def hill(values: list[Column], fractions: list[Column]) -> Column:
    return (voigt(values, fractions) + reuss(values, fractions)) / 2


def gassmann(dry: Column, mineral: Column, fluid: Column, porosity: Column) -> Column:
    """Bulk modulus of the saturated rock (Gassmann, 1951); the shear modulus stays that of the dry rock.

    The last term has the minus sign of the published equation."""
    return dry + F.try_divide(F.pow(1 - dry / mineral, 2), porosity / fluid + (1 - porosity) / mineral - dry / (mineral * mineral))


def between_bounds(upper: Column, lower: Column, weight: Column) -> Column:
    return weight * upper + (1 - weight) * lower


def trend_value(x: Column, start: float, step: float, values: list[float]) -> Column:
    """Linear interpolation in a table of two values or more; held at its ends."""
    last = len(values) - 1
    place = F.greatest(F.lit(0.0), F.least(F.lit(float(last)), (x - start) / step))
    at = F.least(F.floor(place), F.lit(last - 1)).cast("int")
    table = F.array(*[F.lit(float(v)) for v in values])
    return F.get(table, at) * (1 - (place - at)) + F.get(table, at + 1) * (place - at)


def horizon_above(x: Column, spread: float) -> Column:
    """Probability that a horizon lies above a point `x` below its mean place; its error is Beta(2, 2) over +-`spread`."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x + spread) / (2 * spread)))
    return 3 * t * t - 2 * t * t * t


def tapered(trace: Column, n: int) -> Column:
    """An array whose first `n` samples rise from 0 by sin^2(pi k / 2n), and whose last `n` fall to it by cos^2(pi (k + 1) / 2n)."""
    up = lambda k: F.pow(F.sin(k * (math.pi / 2 / n)), F.lit(2.0))
    down = lambda k: F.pow(F.cos((k + 1) * (math.pi / 2 / n)), F.lit(2.0))
    start = F.size(trace) - n
    return F.transform(trace, lambda v, i: v * F.when(i < n, up(i)).otherwise(1.0) * F.when(i >= start, down(i - start)).otherwise(1.0))


def survey_day(year: Column, month: Column, day: Column) -> Column:
    """Day number of a vintage since 1900: no year is day 0, no month is the middle of the year, no day is day 15."""
    before = F.get(F.array(*[F.lit(d) for d in DAYS_BEFORE]), (month - 1).cast("int"))
    since = year - 1900
    return F.coalesce(365 * since + F.floor(since / 4) + F.when(month.isNull(), 182).otherwise(before + F.coalesce(day, F.lit(15))), F.lit(0)).cast("long")


#: Contacts of a grain at porosity 0.20, 0.25, ... 0.70.
COORDINATION = [14.007, 12.336, 10.843, 9.5078, 8.3147, 7.2517, 6.3108, 5.4878, 4.7826, 4.1988, 3.7440]


def coordination(porosity: Column) -> Column:
    """Contacts of a grain, between the values of the table; held at its ends."""
    return trend_value(porosity, 0.2, 0.05, COORDINATION)


def walton(bulk: Column, shear: Column, porosity: Column, pressure: Column, friction: Column, contacts: Column) -> tuple[Column, Column]:
    """Bulk and shear modulus of a dry pack of spheres (Walton, 1987), in units of `bulk` and `shear`, as is the pressure.

    `friction` is the weight of rough spheres; the others are smooth."""
    plane = bulk + shear / 3
    a, b = (1 / shear - 1 / plane) / (4 * math.pi), (1 / shear + 1 / plane) / (4 * math.pi)
    x = F.pow(3 * F.pow(contacts * (1 - porosity), F.lit(2.0)) * pressure / (math.pi**4 * b * b), F.lit(1 / 3))
    return x / 6, x * (friction * (5 * b + a) / (2 * b + a) + (1 - friction)) / 10
