"""Brine (Batzle and Wang, 1992) as Column expressions: temperature in degrees C, pressure in MPa, salinity as a weight fraction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The paper's table of the velocity of water, a row a power of temperature, a column a power of pressure.
WATER_VELOCITY = (
    (1402.85, 1.524, 3.437e-3, -1.197e-5),
    (4.871, -0.0111, 1.739e-4, -1.628e-6),
    (-0.04783, 2.747e-4, -2.135e-6, 1.237e-8),
    (1.487e-4, -6.503e-7, -1.455e-8, 1.327e-10),
    (-2.197e-7, 7.987e-10, 5.230e-11, -4.614e-13),
)


def _polynomial(x: Column, coefficients: list) -> Column:
    """By Horner's rule, the coefficient of x^0 first."""
    out = F.lit(0.0)
    for c in reversed(coefficients):
        out = out * x + c
    return out


def water_density(t: Column, p: Column) -> Column:
    """In g/cm3."""
    by_t = -80 * t - 3.3 * t * t + 0.00175 * t * t * t
    return 1 + 1e-6 * (by_t + 489 * p - 2 * t * p + 0.016 * t * t * p - 1.3e-5 * t * t * t * p - 0.333 * p * p - 0.002 * t * p * p)


def brine_density(t: Column, p: Column, s: Column) -> Column:
    """In g/cm3."""
    return water_density(t, p) + s * (0.668 + 0.44 * s + 1e-6 * (300 * p - 2400 * p * s + t * (80 + 3 * t - 3300 * s - 13 * p + 47 * p * s)))


def water_velocity(t: Column, p: Column) -> Column:
    """In m/s."""
    return _polynomial(t, [_polynomial(p, list(row)) for row in WATER_VELOCITY])


def brine_velocity(t: Column, p: Column, s: Column) -> Column:
    """In m/s. The last term is 820 times the squared salinity, which gives saturated brine its measured velocity; with 1820, which is also seen, it would be 70 m/s less."""
    linear = 1170 - 9.6 * t + 0.055 * t * t - 8.5e-5 * t * t * t + 2.6 * p - 0.0029 * t * p - 0.0476 * p * p
    return water_velocity(t, p) + s * linear + s * F.sqrt(s) * (780 - 10 * p + 0.16 * p * p) - 820 * s * s


def brine_modulus(t: Column, p: Column, s: Column) -> Column:
    """Bulk modulus in kPa for density in g/cm3 and velocity in m/s."""
    v = brine_velocity(t, p, s)
    return brine_density(t, p, s) * v * v
