"""K-means and mixtures fitted many at once."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondage.operators import cluster_report, clustering, features, fits


@pytest.fixture(scope="module")
def blobs(spark):
    """240 points around four centres, far from the origin, in several partitions."""
    random = np.random.RandomState(3)
    x = np.concatenate([random.normal(c, 0.4, (60, 3)) for c in ((0, 0, 0), (6, 0, 0), (0, 6, 0), (0, 0, 6))]) + 1000
    rows = features.from_array(spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>").repartition(3, "id"), "v")
    return x, rows.select("id", "features").cache()


def test_all_k_share_the_passes(blobs):
    passes = {}
    for ks in ([4], [2, 3, 4, 5]):
        points = fits.Points(blobs[1])
        fits.first_centres(points, ks)
        passes[len(ks)] = points.passes
    assert passes[1] == passes[4]
    points = fits.Points(blobs[1])
    fits.kmeans_starts(points, [2, 3, 4, 5], rounds=7)
    assert points.passes <= passes[4] + 7


def test_costs_are_those_of_the_rows(blobs):
    x, rows = blobs
    found, cost = clustering.kmeans(rows, 4)
    own = np.array([r.cluster for r in found.orderBy("id").collect()])
    assert sorted(np.bincount(own)) == [60] * 4
    assert cost == pytest.approx(sum(((x[own == c] - x[own == c].mean(0)) ** 2).sum() for c in range(4)), rel=1e-6)


@pytest.mark.parametrize("kind", ["squared", None])
def test_elbow_measures_as_metrics_do(blobs, kind):
    rows = blobs[1]
    points = fits.Points(rows)
    models = fits.best_starts(fits.kmeans_starts(points, range(2, 6)))
    for r in cluster_report.elbow(rows, 5, kind)[1:3]:
        want = cluster_report.metrics(clustering.nearest(rows, models[r["k"]] + points.shift), kind)
        assert (r["silhouette"] is None) == (kind is None)
        assert [r[m] for m in want if want[m] is not None] == pytest.approx([v for v in want.values() if v is not None], abs=2e-4, rel=1e-5)


@pytest.mark.parametrize("covariance", fits.COVARIANCES)
def test_likelihood_by_brute_force(blobs, covariance):
    x, rows = blobs
    points = fits.Points(rows)
    found = fits.mixtures(points, [1, 4], covariance)
    model, v = found[4], x - points.shift
    density = np.zeros(len(v))
    for w, m, c in zip(model.weights, model.means, model.covariances, strict=True):
        z = v - m
        density += w * np.exp(-0.5 * np.einsum("ia,ab,ib->i", z, np.linalg.inv(c), z)) / np.sqrt(np.linalg.det(2 * np.pi * c))
    assert model.likely == pytest.approx(np.log(density).sum(), abs=1.0)
    assert model.weights == pytest.approx([0.25] * 4, abs=0.01)
    # A single component is the mean and the covariance of all rows.
    full = np.cov(x.T, bias=True) + 1e-6 * np.eye(3)
    want = {"full": full, "tied": full, "diag": np.diag(np.diag(full)), "spherical": np.eye(3) * np.trace(full) / 3}[covariance]
    assert found[1].covariances[0] == pytest.approx(want, abs=1e-6) and found[1].means[0] + points.shift == pytest.approx(x.mean(0))


def test_a_task_that_runs_again_draws_the_same(blobs):
    points = fits.Points(blobs[1])
    a, b = (fits.first_centres(points, [3]) for _ in range(2))
    assert all(np.allclose(a[m], b[m]) for m in a)


def test_odd_rows(spark):
    rows = features.from_array(spark.createDataFrame([(i, [2.0, 3.0]) for i in range(20)] + [(20, None)], "id long, v array<double>"), "v").select("features")
    equal = rows.where("features is not null")
    found, cost = clustering.kmeans(equal, 3)  # one distinct point
    assert found.select("cluster").distinct().count() == 1 and cost == 0
    assert fits.Points(rows).n == 20
    assert [r["calinski_harabasz"] for r in cluster_report.elbow(equal, 3)] == [None, None]
    assert clustering.gaussian_mixture(equal, 2)[0].count() == 20
    with pytest.raises(ValueError, match="no rows"):
        clustering.kmeans(rows.where("features is null"), 2)
    with pytest.raises(ValueError, match="covariance"):
        clustering.gaussian_mixture(rows, 2, "other")
    two = features.from_array(spark.createDataFrame([([0.0],), ([9.0],)], "v array<double>"), "v")
    assert sorted(r.cluster for r in clustering.kmeans(two, 2)[0].collect()) == [0, 1]
    # A third of all rows is one point.
    heavy = features.from_array(spark.range(900).select(F.array(F.when(F.col("id") % 3 == 0, 50.0).otherwise((F.col("id") % 7).cast("double"))).alias("v")), "v")
    sizes = clustering.kmeans(heavy, 2)[0].groupBy("cluster").count().collect()
    assert sorted(r["count"] for r in sizes) == [300, 600]
