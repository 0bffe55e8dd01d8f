"""Temperature rescaling of distributions and reproducible draws from them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from songloom.constants import TEMPERATURES
from songloom.functions.maths import effective_temperature, tempered, uniform


def rescale(dist: DataFrame, temperature: float | Column, by: list[str]) -> DataFrame:
    """Distribution at another temperature; entries of probability 0 go. ``by`` names the distribution."""
    temperature = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    return dist.where(F.col("p") > 0).withColumn("p", tempered(F.col("p"), temperature, by))


def at_temperatures(dist: DataFrame, temperatures: Iterable[float] = TEMPERATURES) -> DataFrame:
    """Every row once per temperature."""
    return dist.withColumn("temperature", F.explode(F.array(*[F.lit(float(t)) for t in temperatures])))


def draw(
    dist: DataFrame, temperature: float | Column, by: list[str], draws: int = 1, seed: int = 0, value: str = "ch"
) -> DataFrame:
    """One value per distribution and draw, at the given temperature.

    The largest of ``ln p / T`` plus Gumbel noise is a draw from the rescaled distribution, which
    therefore need not be normalised: one aggregation with map-side combination. The noise comes from
    the row's own key, so any partitioning gives the same draws.
    """
    temperature = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    trials = dist.where(F.col("p") > 0).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    noise = -F.ln(-F.ln(uniform(F.lit(seed), *[F.col(b) for b in by], F.col("draw"), F.col(value))))
    score = F.ln("p") / effective_temperature(temperature) + noise
    return trials.groupBy(*by, "draw").agg(F.max_by(value, score).alias(value))


def sweep(
    dist: DataFrame,
    by: list[str],
    temperatures: Iterable[float] = TEMPERATURES,
    draws: int = 1,
    seed: int = 0,
    value: str = "ch",
) -> DataFrame:
    """Draws at each of several temperatures."""
    return draw(at_temperatures(dist, temperatures), F.col("temperature"), [*by, "temperature"], draws, seed, value)
