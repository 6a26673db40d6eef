"""Statistics as column expressions over moments."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def adjusted_skew(n: Column, g1: Column) -> Column:
    """Bias-adjusted skewness from the population value; 0 for a constant, null below three values."""
    return F.when(n >= 3, F.coalesce(g1, F.lit(0.0)) * F.sqrt(n * (n - 1)) / (n - 2))


def adjusted_kurtosis(n: Column, g2: Column, constant: Column) -> Column:
    """Bias-adjusted excess kurtosis; 0 for a constant, null below four values."""
    return F.when(n >= 4, F.when(constant, 0.0).otherwise((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)))


def with_k2(rows: DataFrame) -> DataFrame:
    """``rows`` (n, g1, g2, ...) with ``k2``: D'Agostino and Pearson's K² from population skewness and excess kurtosis, for n of 8 or more.

    Worked out in steps: one nested expression would repeat its parts thousands of times in generated code.
    """
    n = F.col("__n")
    square = lambda c: F.col(c) * F.col(c)
    steps = [
        {"__n": F.greatest(F.col("n"), F.lit(8)).cast("double")},
        {
            "__y": F.col("g1") * F.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2))),
            "__beta": 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9)),
            "__s": 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2.0) * (n - 3))),
            "__x": (F.col("g2") + 3 - 3.0 * (n - 1) / (n + 1)) / F.sqrt(24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3.0) * (n + 5))),
        },
        {"__y": F.when(F.col("__y") == 0, 1.0).otherwise(F.col("__y")), "__w": -1 + F.sqrt(2 * (F.col("__beta") - 1)), "__a": 6.0 + 8.0 / F.col("__s") * (2.0 / F.col("__s") + F.sqrt(1 + 4.0 / square("__s")))},
        {"__delta": 1 / F.sqrt(0.5 * F.ln("__w")), "__r": F.col("__y") / F.sqrt(2.0 / (F.col("__w") - 1)), "__d": 1 + F.col("__x") * F.sqrt(2 / (F.col("__a") - 4.0))},
        {"__z1": F.col("__delta") * F.ln(F.col("__r") + F.sqrt(square("__r") + 1)), "__root": F.signum("__d") * F.cbrt((1 - 2.0 / F.col("__a")) / F.abs("__d"))},
        {"__z2": (1 - 2.0 / (9.0 * F.col("__a")) - F.col("__root")) / F.sqrt(2.0 / (9.0 * F.col("__a")))},
        {"k2": F.when(F.col("n") >= 8, square("__z1") + square("__z2"))},
    ]
    for step in steps:
        rows = rows.withColumns(step)
    return rows.drop(*(c for step in steps for c in step if c.startswith("__")))


def erf(x: Column) -> Column:
    """The error function from Abramowitz and Stegun 7.1.26, to 1.5e-7."""
    t = 1 / (1 + 0.3275911 * F.abs(x))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def log_normal_tail(z: Column) -> Column:
    """ln of the normal distribution function; below -5 by the asymptotic series of the tail, whose terms are under 1e-6 of it there."""
    far = F.least(z, F.lit(-5.0))
    q = 1 / (far * far)
    tail = -far * far / 2 - F.ln(-far * math.sqrt(2 * math.pi)) + F.ln(1 - q + 3 * q * q - 15 * q * q * q + 105 * q * q * q * q)
    return F.when(z < -5, tail).otherwise(F.ln(0.5 * (1 + erf(F.greatest(z, F.lit(-5.0)) / 2**0.5))))


def normal_density(x: Column, mean: Column, sd: Column) -> Column:
    z = (x - mean) / sd
    return F.exp(-0.5 * z * z) / (sd * math.sqrt(2 * math.pi))


# Acklam's rational approximation of the inverse normal distribution function, in the middle and in the tails.
MIDDLE = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
MIDDLE_UNDER = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01]
TAIL = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
TAIL_UNDER = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00]


def normal_quantile(p: Column) -> Column:
    """Inverse normal distribution function (relative error 1.2e-9)."""

    def poly(x: Column, terms: list[float]) -> Column:
        out = F.lit(terms[0])
        for t in terms[1:]:
            out = out * x + t
        return out

    def tail(q: Column) -> Column:
        return poly(q, TAIL) / (poly(q, TAIL_UNDER) * q + 1)

    q = p - 0.5
    r = q * q
    middle = poly(r, MIDDLE) * q / (poly(r, MIDDLE_UNDER) * r + 1)
    low = F.sqrt(-2 * F.ln(F.least(p, F.lit(0.02425))))
    high = F.sqrt(-2 * F.ln(F.least(1 - p, F.lit(0.02425))))
    return F.when(p < 0.02425, tail(low)).when(p > 1 - 0.02425, -tail(high)).otherwise(middle)
