"""Rounding, scoring and formatting expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def half_up(value: Column, digits: int) -> Column:
    """Round half away from zero after settling the value at ten decimals.

    The order in which Spark adds up doubles changes the last bits of a mean;
    going through a decimal removes them before they can tip a rounding.
    """
    return F.round(value.cast("decimal(38,10)"), digits).cast("double")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that gives NULL for a zero divisor, also in ANSI mode."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def clamp(value: Column, low: float = 0, high: float = 100) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def step_points(value: Column, steps: Sequence[tuple[float, int]]) -> Column:
    """Points of the first step whose limit the magnitude of ``value`` exceeds."""
    size = F.abs(F.coalesce(value, F.lit(0)))
    points = F.lit(0)
    for limit, gain in reversed(steps):
        points = F.when(size > limit, F.lit(gain)).otherwise(points)
    return points


def level(value: Column, bands: Sequence[tuple[float, str]], default: str | None) -> Column:
    """Name of the highest band that ``value`` reaches; bands run from high to low."""
    name = F.lit(default).cast("string")
    for floor, label in reversed(bands):
        name = F.when(value >= floor, F.lit(label)).otherwise(name)
    return name


def rank_of(value: Column, order: Sequence[str], default: int) -> Column:
    """Position of a code in a fixed list, counted from one."""
    rank = F.lit(default)
    for position, code in reversed(list(enumerate(order, start=1))):
        rank = F.when(value == code, F.lit(position)).otherwise(rank)
    return rank


def scaled_text(value: Column, digits: int) -> Column:
    """Text with a fixed number of decimals, as in a report sentence."""
    return half_up(value, digits).cast(f"decimal(28,{digits})").cast("string")


def plain_number(value: Column, digits: int) -> Column:
    """Shortest text of a number: no trailing zeros and no bare point."""
    return F.regexp_replace(scaled_text(value, digits), r"\.?0+$", "") if digits else scaled_text(value, 0)


def number_or(value: Column, default: float = 0.0) -> Column:
    """A value read as a number, or the default where it is missing or no number."""
    return F.coalesce(value.cast("string").try_cast("double"), F.lit(float(default)))


def text_or(value: Column, default: str = "N/A") -> Column:
    return F.coalesce(value.cast("string"), F.lit(default))
