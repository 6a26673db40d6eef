"""Sums of distances along lines against all pairs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondage.operators import features, lines, pairs, silhouettes


def wanted(x, c, at):
    """Silhouettes of the rows ``at``, by all pairs."""
    out, sizes = [], {k: int((c == k).sum()) for k in set(c.tolist())}
    for i in at:
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        a = d[c == c[i]].sum() / max(sizes[c[i]] - 1, 1)
        b = min(d[c == k].mean() for k in sizes if k != c[i])
        out.append((b - a) / max(a, b) if sizes[c[i]] > 1 else 0.0)
    return out


def rows_of(spark, x, c):
    return features.from_array(spark.createDataFrame([(int(k), v.tolist()) for k, v in zip(c, x, strict=True)], "cluster int, v array<double>"), "v")


def refused(*args):
    raise AssertionError("compared in pairs")


@pytest.mark.parametrize("width", [1, 2, 4])
def test_against_all_pairs(spark, monkeypatch, width):
    """Several cells and small matrices, repeated rows, equal places of several clusters, noise, and a row alone in its cluster."""
    for name, value in {"LEAST": 0, "COST": (0, 0), "CELL": 60, "STEP": 16, "ROOM": 900}.items():
        monkeypatch.setattr(lines, name, value)
    monkeypatch.setattr(pairs, "compare", refused)
    rng = np.random.default_rng(width)
    x = np.column_stack([np.round(rng.normal(50, 2, 400), 2), rng.integers(0, 3, 400) * 0.5, -rng.integers(0, 2, 400) * 3.5, rng.integers(0, 2, 400) * 0.9])[:, :width]
    x[-40:] = x[:40]
    c = np.array([-1, 9, *(np.where(x[2:, 0] > 51, 4, rng.integers(0, 3, 398)))])
    found = silhouettes.euclidean(rows_of(spark, x, c)).collect()
    keep = c >= 0
    got = sorted(v for r in found for v in [r.silhouette] * r.n)
    assert got == pytest.approx(sorted(wanted(x[keep], c[keep], range(keep.sum()))), abs=1e-11)


def test_many_rows_of_a_measure_and_a_category(spark, monkeypatch):
    """The work on a large table doesn't grow with the square of its rows."""
    monkeypatch.setattr(pairs, "compare", refused)
    n = 60_000
    rows = spark.range(n).select((F.col("id") % 3).cast("int").alias("cluster"), F.array(F.col("id") / 7000 + F.col("id") % 3, (F.col("id") % 2).cast("double")).alias("v"))
    ids = np.arange(n)
    x, c = np.column_stack([ids / 7000 + ids % 3, ids % 2]), ids % 3
    found = silhouettes.euclidean(features.from_array(rows, "v"))
    assert found.agg(F.sum("n")).first()[0] == n
    some = sorted(wanted(x, c, [int(np.lexsort((x[:, 0],))[0]), int(np.argmax(x[:, 0]))]))
    low, high = found.agg(F.min("silhouette"), F.max("silhouette")).first()
    got = np.array([r.silhouette for r in found.select("silhouette").collect()])
    assert all(np.abs(got - v).min() < 1e-11 for v in some) and low <= some[0] and some[-1] <= high


def test_layout_leaves_other_tables_to_pairs(spark, monkeypatch):
    """Few points, two features with many values, and lines so close that all pairs are less work."""
    rng = np.random.default_rng(3)
    points = lambda x: spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>")
    line = np.column_stack([rng.normal(size=3000), rng.integers(0, 2, 3000)])
    assert lines.layout(points(line), 3000, 2) is None
    monkeypatch.setattr(lines, "LEAST", 0)
    assert lines.layout(points(line), 3000, 2).axis == 0
    assert lines.layout(points(line * [1, 1e-6]), 3000, 2) is None
    assert lines.layout(points(rng.normal(size=(3000, 2))), 3000, 2) is None
    assert lines.layout(points(np.column_stack([line[:, 0], np.full(3000, np.inf)])), 3000, 2) is None
    assert lines.layout(points(line), 3000, lines.SUMS) is None
