"""Normality of numeric columns: three tests, their consensus, Q-Q points and the fitted curve."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondage.functions.stats import log_normal_tail, normal_density, normal_quantile, with_k2
from sondage.operators import ranks
from sondage.operators import summary as sums
from sondage.operators.profile import numbered, shape
from sondage.operators.types import clean, need, number, numeric_columns
from sondage.sources.staging import Staging

ALPHA = 0.05
#: Values that the Shapiro-Wilk test takes: its approximation holds up to here.
SHAPIRO_VALUES = 5000
CURVE_POINTS = 200


def dagostino(df: DataFrame, columns: list[str] | None = None, found: DataFrame | None = None) -> DataFrame:
    """(column, n, k2, p_value, normal) for columns of at least eight values that aren't constant; else nulls.

    ``found`` are the rows of ``summary.column_ranges`` if they are at hand, else they are one pass.
    """
    columns = columns or numeric_columns(df)
    need(df, *columns, numeric=True)
    found = sums.column_ranges(df, columns) if found is None else found
    rows = with_k2(shape(found, columns).select("column", "n", "g1", "g2"))
    p = F.exp(-F.col("k2") / 2)
    return rows.select("column", "n", F.round("k2", 4).alias("k2"), F.round(p, 6).alias("p_value"), (p >= ALPHA).alias("normal"))


def anderson_darling(df: DataFrame, column: str) -> DataFrame:
    """(column, n, statistic, critical, normal) at five percent, for mean and deviation taken from the data."""
    need(df, column, numeric=True)
    x = ranks.places(ranks.distinct_values(df, column), Staging(df.sparkSession, "anderson"))
    spread = sums.moments(sums.column_ranges(df, [column]), ["column"]).select("mean", F.col("std").alias("sd"))  # one row
    z = (F.col("x") - F.col("mean")) / F.nullif(F.col("sd"), F.lit(0.0))
    lower, upper = log_normal_tail(z), log_normal_tail(-z)
    # In the sum of (2 i - 1) (ln F(x_i) + ln(1 - F(x_(n+1-i)))) each value has the weights of both its places; over equal values, in the places from before + 1 to
    # before + times, these add up to differences of squares.
    n, times, before = (F.col(c).cast("double") for c in ("n", "times", "before"))
    term = times * (2 * before + times) * lower + times * (2 * (n - before) - times) * upper
    one = x.join(F.broadcast(spread)).agg(F.first("n").alias("n"), F.sum(term / n).alias("s"))
    critical = F.round(0.787 / (1 + 4 / F.col("n") - 25 / (F.col("n") * F.col("n"))), 3)
    return one.select(F.lit(column).alias("column"), "n", F.round(-F.col("n") - F.col("s"), 4).alias("statistic"), critical.alias("critical"), (-F.col("n") - F.col("s") < critical).alias("normal"))


def shapiro(values: np.ndarray) -> tuple[float, float]:
    """Statistic and p value of the Shapiro-Wilk test by Royston's approximation; for 3 to 5,000 values that aren't constant."""
    from statistics import NormalDist

    x = np.sort(values)
    n = len(x)
    normal = NormalDist()
    m = np.array([normal.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    c = m / np.sqrt(m @ m)
    u = 1 / np.sqrt(n)
    a = np.zeros(n)
    if n == 3:
        a[0], a[2] = -np.sqrt(0.5), np.sqrt(0.5)
    else:
        last = c[-1] + 0.221157 * u - 0.147981 * u**2 - 2.071190 * u**3 + 4.434685 * u**4 - 2.706056 * u**5
        if n <= 5:
            phi = (m @ m - 2 * m[-1] ** 2) / (1 - 2 * last**2)
            a = m / np.sqrt(phi)
            a[-1], a[0] = last, -last
        else:
            second = c[-2] + 0.042981 * u - 0.293762 * u**2 - 1.752461 * u**3 + 5.682633 * u**4 - 3.582633 * u**5
            phi = (m @ m - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
            a = m / np.sqrt(phi)
            a[-1], a[0], a[-2], a[1] = last, -last, second, -second
    w = min(1.0, float((a @ x) ** 2 / ((x - x.mean()) ** 2).sum()))
    if n == 3:
        return w, float(max(0.0, 6 / np.pi * (np.arcsin(np.sqrt(w)) - np.arcsin(np.sqrt(0.75)))))
    if n <= 11:
        g = -2.273 + 0.459 * n
        y = -np.log(max(g - np.log(1 - w + 1e-300), 1e-300))
        mean = 0.5440 - 0.39978 * n + 0.025054 * n**2 - 0.0006714 * n**3
        sd = np.exp(1.3822 - 0.77857 * n + 0.062767 * n**2 - 0.0020322 * n**3)
    else:
        y, k = np.log(1 - w + 1e-300), np.log(n)
        mean = -1.5861 - 0.31082 * k - 0.083751 * k**2 + 0.0038915 * k**3
        sd = np.exp(-0.4803 - 0.082676 * k + 0.0030302 * k**2)
    return w, 1 - normal.cdf(float((y - mean) / sd))


def shapiro_wilk(df: DataFrame, columns: list[str] | None = None, seed: int = 42) -> DataFrame:
    """(column, n_used, statistic, p_value, normal) on up to ``SHAPIRO_VALUES`` values a column, chosen by a hash of row and seed.

    Each column's values are chosen by smallest hash, which every partition does for itself first; the test then takes one bounded group a column.
    """
    df = clean(df)
    columns = columns or numeric_columns(df)
    need(df, *columns, numeric=True)
    out = None
    for c in columns:
        x = df.select(number(c).alias("x"), F.xxhash64(*df.columns, F.lit(seed)).alias("h")).where("x is not null").orderBy("h", "x").limit(SHAPIRO_VALUES).select(F.lit(c).alias("column"), "x")
        out = x if out is None else out.union(x)

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf["x"].to_numpy()
        w, p = shapiro(x) if len(x) >= 3 and x.min() < x.max() else (None, None)
        return pd.DataFrame({"column": [pdf["column"].iloc[0]], "n_used": [len(x)], "statistic": [w], "p_value": [p]})

    rows = out.groupBy("column").applyInPandas(test, "column string, n_used long, statistic double, p_value double")
    return rows.select("column", "n_used", F.round("statistic", 4).alias("statistic"), F.round("p_value", 6).alias("p_value"), (F.col("p_value") >= ALPHA).alias("normal"))


def verdicts(df: DataFrame, columns: list[str] | None = None, found: DataFrame | None = None) -> DataFrame:
    """(column, n, votes, votes_normal, verdict): normal if at least half the tests that apply say so; insufficient below three values."""
    df = clean(df)
    columns = columns or numeric_columns(df)
    k2, sw = dagostino(df, columns, found), shapiro_wilk(df, columns)
    ad = None
    for c in columns:
        one = anderson_darling(df, c).select("column", F.col("normal").alias("ad"))
        ad = one if ad is None else ad.union(one)
    rows = k2.select("column", "n", F.col("normal").alias("k2")).join(sw.select("column", F.col("normal").alias("sw")), "column", "left").join(ad, "column", "left")
    votes = sum((F.col(x).isNotNull().cast("int") for x in ("k2", "sw", "ad")), F.lit(0))
    yes = sum((F.coalesce(F.col(x).cast("int"), F.lit(0)) for x in ("k2", "sw", "ad")), F.lit(0))
    verdict = F.when((F.col("n") < 3) | (votes == 0), "insufficient").when(2 * yes >= votes, "normal").otherwise("not normal")
    return rows.select("column", "n", votes.alias("votes"), yes.alias("votes_normal"), verdict.alias("verdict"))


def summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("verdict").agg(F.count("*").alias("n_columns"))


def qq_points(df: DataFrame, column: str) -> DataFrame:
    """(i, theoretical, observed): Filliben's medians against the ordered values."""
    need(df, column, numeric=True)
    x = numbered(df, column)
    n, i = F.col("n"), F.col("i")
    half = F.pow(F.lit(0.5), 1 / n)
    median = F.when(i == n, half).when(i == 1, 1 - half).otherwise((i - 0.3175) / (n + 0.365))
    return x.select("i", normal_quantile(median).alias("theoretical"), F.col("x").alias("observed"))


def qq_line(points: DataFrame) -> DataFrame:
    """One row: least-squares slope and intercept, and the correlation."""
    return points.agg(F.regr_slope("observed", "theoretical").alias("slope"), F.regr_intercept("observed", "theoretical").alias("intercept"), F.corr("observed", "theoretical").alias("r"))


def normal_curve(df: DataFrame, column: str, points: int = CURVE_POINTS) -> DataFrame:
    """(x, density) of the fitted normal over the range of the column."""
    need(df, column, numeric=True)
    x = number(column)
    one = clean(df).agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd")).where("sd > 0")
    at = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("k") / (points - 1)
    return one.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k")).select("k", at.alias("x"), normal_density(at, F.col("mean"), F.col("sd")).alias("density"))


def suggestion(skew: Column, kurtosis: Column, least: Column) -> Column:
    """The transformation that brings a column nearer to a normal one."""
    return F.when((skew > 1) & (least >= 0), "log1p").when(skew > 0.5, "sqrt").when(skew < -1, "square").when(F.abs(kurtosis) > 3, "yeo-johnson or box-cox").otherwise("yeo-johnson")


def suggestions(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, suggestion), null for columns that the tests together call normal."""
    df = clean(df)
    columns = columns or numeric_columns(df)
    found = sums.column_ranges(df, columns)
    rows = shape(found, columns).select("column", suggestion(F.col("skewness"), F.col("kurtosis"), F.col("min")).alias("suggestion"))
    return rows.join(verdicts(df, columns, found).select("column", "verdict"), "column").select("column", F.when(F.col("verdict") != "normal", F.col("suggestion")).alias("suggestion"))
