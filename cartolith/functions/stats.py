"""Statistics as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lift(co: Column, a: Column, b: Column, n: Column) -> Column:
    """Observed over expected co-occurrences."""
    return co * n / (a * b)


def wilson_lower(successes: Column, trials: Column, z: float = 1.96) -> Column:
    """Lower end of the Wilson interval; 0 without trials."""
    p = successes / trials
    centre = p + z * z / (2 * trials)
    margin = z * F.sqrt((p * (1 - p) + z * z / (4 * trials)) / trials)
    return F.when(trials > 0, (centre - margin) / (1 + z * z / trials)).otherwise(0.0)


def log_likelihood(co: Column, a: Column, b: Column, n: Column) -> Column:
    """G squared of the 2 by 2 table with ``co`` in both, ``a`` and ``b`` in each, ``n`` in all."""

    def part(observed: Column, expected: Column) -> Column:
        return F.when(observed > 0, observed * F.ln(observed / expected)).otherwise(0.0)

    return 2 * (
        part(co, a * b / n)
        + part(a - co, a * (n - b) / n)
        + part(b - co, (n - a) * b / n)
        + part(n - a - b + co, (n - a) * (n - b) / n)
    )


def significance(g2: Column) -> Column:
    """Label of G squared at the 5, 1 and 0.1 per cent points of chi squared with one degree of freedom."""
    return (
        F.when(g2 >= 10.83, "very strong").when(g2 >= 6.63, "strong").when(g2 >= 3.84, "moderate").otherwise("weak")
    )


def min_max(value: Column, low: Column, high: Column) -> Column:
    """Scaled to 0..1; 0 where there is no range."""
    return F.when(high > low, (value - low) / (high - low)).otherwise(0.0)


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def sigmoid(value: Column) -> Column:
    return 1 / (1 + F.exp(-value))
