"""Places in a whole column, with outliers and ties."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondage.operators import normality, profile, ranks
from sondage.sources.staging import Staging


def frame(spark, values):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double").repartition(3)


def test_an_outlier_fills_no_range(spark):
    """20,000 values and one far away are dealt evenly over more than a hundred ranges."""
    rows = ranks.in_ranges(ranks.distinct_values(frame(spark, [*range(20_000), 1e15]), "x"), Staging(spark, "test"))
    sizes = [r["count"] for r in rows.groupBy("part").count().collect()]
    assert len(sizes) >= 100 and max(sizes) < 1000
    bounds = sorted((r.lo, r.hi) for r in rows.groupBy("part").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).collect())
    assert all(a[1] < b[0] for a, b in zip(bounds, bounds[1:], strict=False))


@pytest.mark.parametrize("at_once", [65_536, 7])
def test_places_one_by_one(spark, monkeypatch, at_once):
    monkeypatch.setattr(ranks, "AT_ONCE", at_once)
    rng = np.random.default_rng(2)
    values = [*rng.normal(size=500), *[3.0] * 400, *rng.integers(0, 5, 300), None, math.nan, -0.0, 0.0]
    found = sorted((r.i, r.x, r.n) for r in profile.numbered(frame(spark, values), "x").collect())
    want = sorted(v for v in values if v is not None and v == v)
    assert found == [(i, x, len(want)) for i, x in enumerate(want, 1)]


def test_empty_and_single(spark):
    assert profile.numbered(frame(spark, [None]), "x").collect() == []
    assert [tuple(r) for r in profile.numbered(frame(spark, [2]), "x").collect()] == [(2.0, 1, 1)]


def test_anderson_with_ties(spark):
    rng = np.random.default_rng(7)
    x = np.sort(np.round(np.concatenate([rng.normal(5, 2, 600), [5.0] * 50, [40.0]]), 1))
    n, z, cdf = len(x), (x - x.mean()) / x.std(ddof=1), NormalDist().cdf
    logs = [math.log(cdf(v)) for v in z], [math.log(0.5 * math.erfc(v / math.sqrt(2))) for v in z]
    want = -n - sum((2 * i + 1) * (logs[0][i] + logs[1][n - 1 - i]) for i in range(n)) / n
    row = normality.anderson_darling(frame(spark, x), "x").first()
    assert row.n == n and row.statistic == pytest.approx(want, rel=1e-4) and row.normal == (want < row.critical)
