"""Sharpe ratios and their significance, as aggregates and column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .normal import EULER, phi, phi_inverse


def sharpe(n: Column, mean: Column, std: Column) -> Column:
    """Mean over sample deviation, not annualised; 0 for fewer than two returns or none that differ."""
    return F.when((n >= 2) & (std > 0), mean / std).otherwise(F.lit(0.0))


def skew(n: Column, g1: Column) -> Column:
    """Bias-corrected skewness from the population's; 0 for fewer than three."""
    return F.when((n >= 3) & g1.isNotNull() & ~F.isnan(g1), g1 * F.sqrt(n * (n - 1)) / (n - 2)).otherwise(F.lit(0.0))


def kurtosis(n: Column, g2: Column) -> Column:
    """Bias-corrected kurtosis (3 for a normal) from the population's excess; 3 for fewer than four."""
    return F.when((n >= 4) & g2.isNotNull() & ~F.isnan(g2), ((n + 1) * g2 + 6) * (n - 1) / ((n - 2) * (n - 3)) + 3).otherwise(F.lit(3.0))


def moments(returns: DataFrame, by: list[str], value: str = "ret") -> DataFrame:
    """by, n, sharpe, skew, kurtosis: one aggregation."""
    x = F.col(value)
    rows = returns.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.stddev_samp(x).alias("s"), F.skewness(x).alias("g1"), F.kurtosis(x).alias("g2"))
    n = F.col("n")
    return rows.select(*by, "n", sharpe(n, F.col("m"), F.col("s")).alias("sharpe"), skew(n, F.col("g1")).alias("skew"), kurtosis(n, F.col("g2")).alias("kurtosis"))


def probabilistic_sharpe(sr: Column, benchmark: Column, n: Column, skewness: Column, kurt: Column) -> Column:
    """Probability that the true ratio exceeds the benchmark; 0 for fewer than two returns."""
    spread = F.sqrt(F.greatest(1 - skewness * sr + (kurt - 1) / 4 * sr * sr, F.lit(1e-12)))
    return F.when(n >= 2, phi((sr - benchmark) * F.sqrt(n - 1) / spread)).otherwise(F.lit(0.0))


def expected_max_sharpe(variance: Column, trials: Column) -> Column:
    """The ratio that the best of so many unskilled trials is expected to show; 0 for one trial or no variance."""
    best = (1 - EULER) * phi_inverse(1 - 1 / trials) + EULER * phi_inverse(1 - 1 / (trials * math.e))
    return F.when((trials >= 2) & (variance > 0), F.sqrt(variance) * best).otherwise(F.lit(0.0))


def deflated(rows: DataFrame, trials: Column, variance: Column) -> DataFrame:
    """moments() with sr0, psr_vs_zero and dsr; all of them null for fewer than two returns."""
    few = F.col("n") < 2
    rows = rows.withColumn("sr0", F.when(~few, expected_max_sharpe(variance, trials)))
    args = (F.col("n"), F.col("skew"), F.col("kurtosis"))
    return rows.select(
        "*",
        F.when(~few, probabilistic_sharpe(F.col("sharpe"), F.lit(0.0), *args)).alias("psr_vs_zero"),
        F.when(~few, probabilistic_sharpe(F.col("sharpe"), F.col("sr0"), *args)).alias("dsr"),
    )
