"""Comparison of two retrieval systems: paired t-test and gate."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _continued_fraction(a: float, b: float, x: float) -> float:
    """Lentz's evaluation of the continued fraction of the incomplete beta function."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + numerator * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + numerator / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    if x < (a + 1) / (a + b + 2):
        return front * _continued_fraction(a, b, x) / a
    return 1 - front * _continued_fraction(b, a, 1 - x) / b


def two_tailed(t: float, freedom: float) -> float:
    """Probability of a t at least so far from 0."""
    return incomplete_beta(freedom / 2, 0.5, freedom / (freedom + t * t))


@F.pandas_udf(DoubleType())
def _p_value(t: pd.Series, freedom: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(x) else two_tailed(float(x), float(n)) for x, n in zip(t, freedom, strict=True)], dtype="float64")


def paired_t_test(pairs: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """Mean difference b - a, its deviation, t and two-tailed p of each group; null without spread or with one pair."""
    from cartolith.session import ship_package

    ship_package(pairs.sparkSession)
    difference = F.col(b) - F.col(a)
    rolled = pairs.groupBy(group).agg(
        F.count(difference).alias("n"), F.avg(difference).alias("mean"), F.stddev_samp(difference).alias("sd")
    )
    t = F.when((F.col("n") > 1) & (F.col("sd") > 0), F.col("mean") / (F.col("sd") / F.sqrt("n")))
    return rolled.withColumn("t", t).withColumn("p", _p_value("t", F.col("n") - 1))


def gate(gain: Column, gain_p: Column, recall: Column, recall_p: Column) -> Column:
    """Passes if nDCG gains significantly and recall does not fall by more than 0.02, or not significantly."""
    better = (gain > 0) & (F.coalesce(gain_p, F.lit(1.0)) < 0.05)
    held = (recall >= -0.02) | (F.coalesce(recall_p, F.lit(1.0)) >= 0.05)
    return F.when(better & held, "PASS").otherwise("FAIL")
