"""Scalar functions of rock and grid values, as Column expressions (JVM-side, in generated code)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ln(1e6), which turns Pa into MPa; codes that input files use for a missing value.
LN_MILLION = 13.81551
MISSING = (-99999.0, -999.0, -999.25)


def null_if_missing(value: Column) -> Column:
    return F.when(~value.isin(*MISSING), value)


def allowed(value: Column, low: float, high: float) -> Column:
    """The value, or null outside [low, high]; the row stays."""
    return F.when(value.between(low, high), value)


def log(value: Column) -> Column:
    """Natural logarithm as IEEE has it, not null: -inf at zero, NaN below."""
    return F.when(value == 0, F.lit(-math.inf)).when(value < 0, F.lit(math.nan)).otherwise(F.ln(value))


def elastic_attributes(a: Column, b: Column, r: Column) -> dict[str, Column]:
    """Attributes from ln(vp), ln(vs), ln(rho)."""
    ratio2 = F.exp(2 * (a - b))
    return {
        "ai": F.exp(a + r),
        "si": F.exp(b + r),
        "vpvs": F.exp(a - b),
        "poisson": 0.5 * F.try_divide(ratio2 - 2, ratio2 - 1),
        "mu": F.exp(r + 2 * b - LN_MILLION),
        "lambda": F.exp(r) * (F.exp(2 * a - LN_MILLION) - 2 * F.exp(2 * b - LN_MILLION)),
        "lambda_rho": F.exp(2 * (a + r) - LN_MILLION) - 2 * F.exp(2 * (b + r) - LN_MILLION),
        "mu_rho": F.exp(2 * (b + r) - LN_MILLION),
    }


def reflection_row(angle_degrees: float, vpvs: float = 2.0) -> tuple[float, float, float]:
    """Weak-contrast Aki-Richards weights of ln(vp), ln(vs), ln(rho) for PP reflection."""
    sin2, tan2 = math.sin(math.radians(angle_degrees)) ** 2, math.tan(math.radians(angle_degrees)) ** 2
    k = sin2 / vpvs**2
    return 0.5 * (1 + tan2), -4 * k, 0.5 * (1 - 4 * k)


def impedance(a: Column, b: Column, r: Column, angle_degrees: float, vpvs: float = 2.0) -> Column:
    x, y, z = reflection_row(angle_degrees, vpvs)
    return x * a + y * b + z * r


def spherical(h: Column) -> Column:
    return F.when(h < 1, 1 - 1.5 * h + 0.5 * h * h * h).otherwise(F.lit(0.0))


def general_exponential(h: Column, power: float = 1.0) -> Column:
    return F.exp(-3 * F.pow(h, F.lit(power)))


def anisotropic_distance(dx: Column, dy: Column, range1: float, range2: float, angle: float) -> Column:
    """Distance in units of the range, in an ellipse turned by `angle` radians."""
    c, s = math.cos(angle), math.sin(angle)
    return F.sqrt(F.pow((c * dx + s * dy) / range1, 2) + F.pow((c * dy - s * dx) / range2, 2))


def ricker(t: Column, peak_hz: float) -> Column:
    c = F.pow(math.pi * peak_hz * t, F.lit(2.0))
    return (1 - 2 * c) * F.exp(-c)


def years_between(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier) / 365.24


def smooth_size(n: int) -> int:
    """Smallest integer of at least n whose prime factors are 2, 3, 5 and 7."""
    while True:
        rest = n
        for p in (2, 3, 5, 7):
            while rest % p == 0:
                rest //= p
        if rest == 1:
            return n
        n += 1
