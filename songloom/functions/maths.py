"""Numeric functions."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def percent(part: Column, whole: Column, digits: int = 3) -> Column:
    """Share in percent, rounded; null for an empty whole."""
    return F.round(F.try_divide(F.lit(100.0) * part, whole), digits)


def smaller(left: Column, right: Column) -> Column:
    """Smaller of two integers."""
    return F.least(left, right)


def effective_temperature(temperature: Column) -> Column:
    """Temperature 0 stands for 1."""
    return F.when(temperature == 0, F.lit(1.0)).otherwise(temperature.cast("double"))


def tempered(p: Column, temperature: Column, by: list[str]) -> Column:
    """``p ** (1 / T)`` normalised over ``by``; exponents are shifted by their maximum so that none overflows."""
    within = Window.partitionBy(*by)
    exponent = F.ln(p) / effective_temperature(temperature)
    weight = F.exp(exponent - F.max(exponent).over(within))
    return weight / F.sum(weight).over(within)


def uniform(*parts: Column) -> Column:
    """Uniform number in (0, 1) computed from the given values alone.

    A hash of the row's key replaces a random generator, so that a recomputed or differently placed
    row gets the same number.
    """
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    bits = F.conv(F.substring(digest, 1, 12), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(float(2**48))
