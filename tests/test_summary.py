"""Sums by ranges and quantiles by refinement against plain NumPy."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondage.operators import profile, summary

P = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


def columns():
    rng = np.random.default_rng(3)
    n = 3000
    return {
        "plain": rng.normal(10, 3, n),
        "outlier": np.append(rng.uniform(0, 1, n - 1), 1e15),
        "tiny": rng.normal(0, 1e-12, n),
        "offset": 1e9 + rng.normal(0, 1e-3, n),
        "powers": 2.0 ** rng.integers(-1000, 1000, n),
        "signs": np.concatenate([-rng.lognormal(0, 40, n // 2), rng.lognormal(0, 40, n - n // 2)]),
        "few": rng.integers(0, 3, n).astype(float),
        "constant": np.full(n, 7.5),
        "hot": np.where(rng.random(n) < 0.4, 42.0, rng.normal(42, 1e-9, n)),
        "subnormal": rng.integers(0, 50, n) * 5e-324,
    }


@pytest.fixture(scope="module")
def data(spark):
    values = columns()
    rows = [tuple(float(v) for v in r) for r in zip(*values.values(), strict=True)]
    return values, spark.createDataFrame(rows, list(values)).repartition(3).cache()


@pytest.mark.parametrize("few", [100_000, 50])
def test_quantiles(spark, data, monkeypatch, few):
    monkeypatch.setattr(summary, "FEW", few)
    values, df = data
    got = summary.column_quantiles(df, list(values), P)
    for c, x in values.items():
        x = np.sort(x)
        for p in P:
            at = (len(x) - 1) * p
            lo, hi = x[math.floor(at)], x[math.ceil(at)]
            share = at - math.floor(at)
            want = lo if share == 0 or lo == hi else (1 - share) * lo + share * hi
            assert got[c][p] == want, (c, p)


def test_rounds_stay_few(spark, data, monkeypatch):
    """Values of any scale are found in a few passes."""
    monkeypatch.setattr(summary, "FEW", 20)
    monkeypatch.setattr(summary, "PARTS", 16)
    values, df = data
    assert summary.column_quantiles(df.select("outlier", "offset"), ["outlier", "offset"], [0.5]).keys() == {"outlier", "offset"}


def test_infinities_nulls_and_empty_columns(spark):
    rows = [(1.0, None, math.inf, None, True), (2.0, None, -math.inf, math.nan, False), (4.0, None, 3.0, 5.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e boolean")
    got = summary.column_quantiles(df, list("abcde"), [0.5, 1.0])
    assert got == {"a": {0.5: 2.0, 1.0: 4.0}, "c": {0.5: 3.0, 1.0: math.inf}, "d": {0.5: 5.0, 1.0: 5.0}, "e": {0.5: 0.5, 1.0: 1.0}}
    assert summary.column_quantiles(df.limit(0), ["a"], [0.5]) == {}
    row = {r["column"]: r for r in profile.numeric_profile(df, ["a", "b", "d"]).collect()}
    assert (row["b"].n, row["b"].n_missing, row["b"].median) == (0, 3, None)
    assert (row["d"].n, row["d"].n_missing, row["d"].skewness) == (1, 2, None)


def test_weights_and_keys(spark):
    rng = np.random.default_rng(5)
    rows = [(f"k{rng.integers(3)}", int(rng.integers(2)), float(rng.normal()), int(rng.integers(0, 5))) for _ in range(400)]
    df = spark.createDataFrame(rows, "k string, i int, x double, w long")
    got = {(r.k, r.i, r.p): r.value for r in summary.quantiles(df, ["k", "i"], [0.3, 0.5], weight="w").collect()}
    for key in {(r[0], r[1]) for r in rows}:
        x = np.repeat([r[2] for r in rows if r[:2] == key], [r[3] for r in rows if r[:2] == key])
        for p in (0.3, 0.5):
            assert got[(*key, p)] == pytest.approx(np.quantile(x, p), rel=1e-12)


def test_without_broadcast(spark, data, monkeypatch):
    monkeypatch.setattr(summary, "MOST_SENT", 0)
    values, df = data
    assert summary.column_quantiles(df, ["plain"], [0.5])["plain"][0.5] == pytest.approx(np.median(values["plain"]), rel=1e-12)


def test_moments_merge(spark, data):
    """The moments of whole columns from those of ranges, also far from zero and with outliers."""
    values, df = data
    names = ["plain", "tiny", "offset", "few", "constant", "hot", "outlier"]
    got = {r["column"]: r for r in summary.moments(summary.column_ranges(df, names), ["column"]).collect()}
    for c in names:
        x = values[c].astype(np.longdouble)
        d = x - x.mean()
        v = (d**2).mean()
        assert got[c].n == len(x) and got[c].lo == x.min() and got[c].hi == x.max()
        assert got[c].mean == pytest.approx(float(x.mean()), rel=1e-9, abs=1e-15)
        assert got[c].std == pytest.approx(float(np.sqrt((d**2).sum() / (len(x) - 1))), rel=1e-5)
        if c == "constant":
            assert got[c].g1 is None and got[c].g2 is None
        else:
            assert got[c].g1 == pytest.approx(float((d**3).mean() / v**1.5), rel=1e-3, abs=1e-3)
            assert got[c].g2 == pytest.approx(float((d**4).mean() / v**2 - 3), rel=1e-3, abs=1e-3)


def test_no_task_holds_the_values_of_a_column(spark):
    """What comes out of a round is bounded by the parts of the ranges that are looked into, whatever the column."""
    x = spark.range(200_000).select(F.lit("x").alias("column"), (F.col("id") * 1.0 + 1e6).alias("x"))
    found = summary.ranges(x, ["column"])
    assert found.count() < 10
    assert summary.quantiles(x, ["column"], [0.5]).first().value == 1e6 + 199_999 / 2
