"""Numbers: coercion, ranges, tiers and the small formulas of the domain."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def number_or_zero(c: Column) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def number_or_null(c: Column) -> Column:
    """Blank, invalid and not-a-number values are NULL."""
    d = F.nullif(F.trim(c), F.lit("")).try_cast("double")
    return F.when(~F.isnan(d), d)


def rounded(c: Column, digits: int) -> Column:
    """``c`` to ``digits`` decimals as SQL engines on binary doubles do: scaled, rounded half away from zero, scaled back. Spark's own round goes by the shortest decimal
    text of a double, so values next to a half (0.5005 is a little less) fall on the other side. Infinite, not-a-number and huge values stay as they are."""
    whole = F.round(c * F.lit(10.0**digits), 0)
    return F.when(F.abs(c) < 2.0**52, whole / F.lit(10.0**digits)).otherwise(c)


def in_range(c: Column, low: float | None, high: float | None) -> Column:
    """Without bounds all pass; with one, NULL fails."""
    if low is None and high is None:
        return F.lit(True)
    ok = c.isNotNull()
    if low is not None:
        ok &= c >= low
    if high is not None:
        ok &= c <= high
    return F.coalesce(ok, F.lit(False))


def sweetness_tier(c: Column) -> Column:
    return F.when(c.isNull(), "unknown").when(c < 1, "below-sucrose").when(c < 10, "low").when(c <= 1000, "medium").otherwise("high")


def lipinski_violations(mw: Column, logp: Column, donors: Column, acceptors: Column) -> Column:
    """Broken rules of five; NULL breaks none. At most one passes."""
    over = lambda c, most: F.coalesce((c > most).cast("int"), F.lit(0))
    return over(mw, 500) + over(logp, 5) + over(donors, 5) + over(acceptors, 10)


def scaled(c: Column, low: float, high: float) -> Column:
    """0 to 100 between the bounds, clamped."""
    return F.least(F.greatest((c - low) / (high - low), F.lit(0.0)), F.lit(1.0)) * 100


def log_sweetness(ddg: Column) -> Column:
    """Of a binding free energy in kcal/mol, clamped to [-25, 15]."""
    return (F.least(F.greatest(ddg, F.lit(-25.0)), F.lit(15.0)) + 20.72) / 10.13


def confidence(p: Column) -> Column:
    d = F.abs(p - 0.5)
    return F.when(d > 0.3, "high").when(d > 0.15, "medium").otherwise("low")


def salt_pairs(molar: Column, volume: Column) -> Column:
    return F.greatest(F.lit(1), F.round(F.lit(6.02214e-4) * molar * volume).cast("int"))


def pressure(chars: Column, seconds: Column, errors: Column) -> Column:
    """Load of a document: chunks of 462 characters, ten a second, ten thousand an error."""
    return F.ceil(chars / 462) + 10 * seconds + 10000 * errors


def recency(year: Column, as_of: int) -> Column:
    """5 to 1 by age in years (2, 5, 10, 20); unknown: 3."""
    age = F.lit(as_of) - year
    return F.when(year.isNull(), 3.0).when(age <= 2, 5.0).when(age <= 5, 4.0).when(age <= 10, 3.0).when(age <= 20, 2.0).otherwise(1.0)


def proximity(a: Column, b: Column) -> Column:
    """exp(-|log10 a - log10 b|), NULL unless both are positive."""
    return F.when((a > 0) & (b > 0), F.exp(-F.abs(F.log10(a) - F.log10(b))))


def threshold_grid(start: float, step: float, least: float) -> list[float]:
    """Thresholds that repeated subtraction passes, the last at ``least``; nothing below a start that is already there."""
    grid = [start]
    while grid[-1] > least and step > 0 and not math.isinf(grid[-1]):
        grid.append(max(least, grid[-1] - step))
    return grid
