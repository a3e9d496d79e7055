"""Scalar functions of the models and masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOAT_MAX = 3.4028235e38
# Abramowitz and Stegun 7.1.26, the error function to 1.5e-7.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def normal_cdf(z: Column) -> Column:
    """The standard normal distribution function."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = F.lit(1.0) / (x * ERF_P + 1.0)
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    tail = poly * F.exp(-x * x) / 2
    return F.when(z >= 0, F.lit(1.0) - tail).otherwise(tail)


def finite(c: Column) -> Column:
    """NULL for what no 4-byte float can hold; NaN is above every number and goes too."""
    return F.when(F.abs(c) <= FLOAT_MAX, c)


def clipped(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def root(y: Column) -> Column:
    """Square root of positive values, 0 for others, NULL for NULL."""
    return F.when(y > 0, F.sqrt(y)).when(y.isNotNull(), F.lit(0.0))


def square(y: Column) -> Column:
    """Square of positive values, 0 for others, NULL for NULL."""
    return F.when(y > 0, y * y).when(y.isNotNull(), F.lit(0.0))


def haze_distance(blue: Column, red: Column, slope: Column, intercept: Column) -> Column:
    """Distance of an observation from the clear-sky line red = intercept + slope * blue."""
    return F.abs(blue * slope - red + intercept) / F.sqrt(slope * slope + 1.0)


def gauge_level(v: Column) -> Column:
    """Step 1 to 4 of a biomass gauge of 2500 kg/ha with edges at 500, 1000 and 1500."""
    return F.when(v < 500, 1).when(v < 1000, 2).when(v < 1500, 3).when(v.isNotNull(), 4)


def radians100(c: Column) -> Column:
    """Angles stored as hundredths of a degree."""
    return F.radians(c * 0.01)


def small_int(c: Column) -> Column:
    """Truncated to 2 bytes; NULL if missing, not finite or out of range."""
    return F.when(F.abs(c) < 32768, c).try_cast("short")
