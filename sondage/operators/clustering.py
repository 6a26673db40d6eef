"""Clustering of rows with a vector column ``features``: k-means, Gaussian mixtures, DBSCAN, agglomerative, mean-shift.

The models of k-means and mixtures are fitted together in ``fits``. DBSCAN is in ``dbscan``.
Agglomerative clustering and mean-shift are quadratic: they are fitted on a sample of at most ``SAMPLE`` rows with the smallest
hashes, and every row is then assigned to the nearest centre. Noise has the label -1.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sondage.operators import fits
from sondage.operators.dbscan import dbscan
from sondage.operators.fits import SEED

__all__ = ["agglomerative", "bandwidth", "cut", "dbscan", "dendrogram", "gaussian_mixture", "kmeans", "mean_shift", "merges", "nearest", "relabelled", "sample", "tsne"]

SAMPLE = 2000
#: Rows that the bandwidth of mean-shift is estimated on.
BANDWIDTH_ROWS = 500
LINKAGES = ("ward", "complete", "average", "single")


def sample(rows: DataFrame, most: int = SAMPLE, seed: int = SEED) -> np.ndarray:
    """At most ``most`` feature vectors with the smallest hashes, in order of hash."""
    x = rows.select(vector_to_array("features").alias("x"))
    found = x.select("x", F.xxhash64("x", F.lit(seed)).alias("h")).orderBy("h", "x").limit(most).select("x").collect()
    return np.array([r.x for r in found], float).reshape(len(found), -1)


def nearest(rows: DataFrame, centres: np.ndarray, within: float | None = None) -> DataFrame:
    """``rows`` with the index of the nearest centre as ``cluster``, -1 beyond ``within``. Ties: the first centre."""

    @F.pandas_udf("int")
    def label(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype="int32")
        x = np.stack(x.to_numpy())
        d = ((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)[None, :]).clip(0)
        found = d.argmin(1)
        if within is not None:
            found[d.min(1) > within * within] = -1
        return pd.Series(found.astype("int32"))

    return rows.withColumn("cluster", label(vector_to_array("features")))


def relabelled(rows: DataFrame) -> DataFrame:
    """Clusters numbered by size, largest first, ties by the mean of the first feature, then by the least vector; noise stays -1."""
    x = vector_to_array("features")
    sizes = rows.where("cluster >= 0").groupBy("cluster").agg(F.count("*").alias("n"), F.avg(x[0]).alias("x"), F.min(x).alias("least"))
    order = sizes.select("cluster", (F.row_number().over(Window.orderBy(F.desc("n"), "x", "least")) - 1).cast("int").alias("__new"))  # one row a cluster
    return rows.join(F.broadcast(order), "cluster", "left").withColumn("cluster", F.coalesce("__new", F.lit(-1))).drop("__new")


def kmeans(rows: DataFrame, k: int, seed: int = SEED) -> tuple[DataFrame, float]:
    """Rows with ``cluster``, and the sum of squared distances."""
    if k < 2:
        raise ValueError("k must be at least 2")
    points = fits.Points(rows)
    # The best of a few starts, as a single one may end in a poor optimum.
    centres = fits.best_starts(fits.kmeans_starts(points, [k], seed))[k]
    cost = float(points.sums(lambda v: np.array([fits.distances(v, centres).min(1).sum()]))[0])
    points.drop()
    return nearest(rows, centres + points.shift), cost


def gaussian_mixture(rows: DataFrame, k: int, covariance: str = "full", seed: int = SEED) -> tuple[DataFrame, float]:
    """Rows with ``cluster``, and the log likelihood."""
    points = fits.Points(rows)
    model = fits.mixtures(points, [k], covariance, seed)[k]
    points.drop()

    @F.pandas_udf("int")
    def label(x: pd.Series) -> pd.Series:
        return pd.Series(model.densities(np.stack(x.to_numpy()) - model.shift).argmax(1).astype("int32")) if len(x) else pd.Series([], dtype="int32")

    return rows.withColumn("cluster", label(vector_to_array("features"))), model.likely


def merges(x: np.ndarray, linkage: str = "ward") -> np.ndarray:
    """Rows (a, b, height, size) of the hierarchy of the points, by nearest-neighbour chains of Lance-Williams distances.

    As in the common convention, new clusters are numbered from the count of points on, and rows go by height.
    """
    if linkage not in LINKAGES:
        raise ValueError(f"linkage must be one of {LINKAGES}")
    n = len(x)
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(2)) if n * n * x.shape[1] <= 5e7 else np.sqrt(np.maximum((x**2).sum(1)[:, None] - 2 * x @ x.T + (x**2).sum(1)[None, :], 0))
    d[np.arange(n), np.arange(n)] = np.inf
    size, alive, chain, raw = np.ones(n), np.ones(n, bool), [], []
    for _ in range(n - 1):
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        while True:
            a = chain[-1]
            row = np.where(alive, d[a], np.inf)
            b = int(row.argmin())
            if len(chain) > 1 and row[chain[-2]] <= row[b]:
                b = chain[-2]
                break
            chain.append(b)
        chain = chain[:-2]
        a, b = min(a, b), max(a, b)
        h = d[a, b]
        raw.append((a, b, h))
        if linkage == "single":
            new = np.minimum(d[a], d[b])
        elif linkage == "complete":
            new = np.maximum(d[a], d[b])
        elif linkage == "average":
            new = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        else:
            total = size[a] + size[b] + size
            new = np.sqrt(np.maximum(((size[a] + size) * d[a] ** 2 + (size[b] + size) * d[b] ** 2 - size * h * h) / total, 0))
        size[b] += size[a]
        alive[a] = False
        d[b], d[:, b] = new, new
        d[b, b] = np.inf
        d[a], d[:, a] = np.inf, np.inf
    raw.sort(key=lambda m: m[2])
    parent, held, out = list(range(2 * n - 1)), [1] * n, []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for k, (a, b, h) in enumerate(raw):
        a, b = sorted((root(a), root(b)))
        parent[a] = parent[b] = n + k
        held.append(held[a] + held[b])
        out.append((a, b, h, held[n + k]))
    return np.array(out).reshape(len(out), 4)


def cut(tree: np.ndarray, n: int, k: int) -> np.ndarray:
    """Labels of the points when ``k`` clusters are left."""
    parent = list(range(2 * n - 1))
    for i, (a, b, _, _) in enumerate(tree[: n - k]):
        parent[int(a)] = parent[int(b)] = n + i

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    return np.unique([root(i) for i in range(n)], return_inverse=True)[1]


def agglomerative(rows: DataFrame, k: int, linkage: str = "ward", most: int = SAMPLE) -> DataFrame:
    """``rows`` with ``cluster``: the hierarchy of the sample, and every row at the nearest mean of its clusters."""
    x = sample(rows, most)
    labels = cut(merges(x, linkage), len(x), min(k, len(x)))
    return nearest(rows, np.stack([x[labels == c].mean(0) for c in range(labels.max() + 1)]))


def dendrogram(rows: DataFrame, most: int = 300, linkage: str = "ward") -> DataFrame:
    """(step, a, b, height, size, above): the merges of a sample, and whether they lie above 0.7 of the greatest height."""
    tree = merges(sample(rows, most), linkage)
    top = tree[:, 2].max() if len(tree) else 0.0
    return rows.sparkSession.createDataFrame([(i, int(a), int(b), float(h), int(s), bool(h > 0.7 * top)) for i, (a, b, h, s) in enumerate(tree)], "step int, a int, b int, height double, size int, above boolean")


def tsne(rows: DataFrame, key: str, most: int = 3000, rounds: int = 500, seed: int = SEED) -> DataFrame:
    """(key, x, y) of a sample of at most ``most`` rows by t-distributed neighbour embedding; equal rows share a place.

    No rows with fewer than four distinct ones. The embedding is a picture of a bounded sample, so it is worked out in one place.
    """
    x = rows.select(F.col(key).alias("id"), vector_to_array("features").alias("x"))
    found = x.select("id", "x", F.xxhash64("x", F.lit(seed)).alias("h")).orderBy("h", "id").limit(most).select("id", "x").collect()
    schema = f"{key} {rows.schema[key].dataType.simpleString()}, x double, y double"
    distinct = {tuple(r.x) for r in found}
    if len(distinct) < 4:
        return rows.sparkSession.createDataFrame([], schema)
    points, back = np.unique(np.array([r.x for r in found], float), axis=0, return_inverse=True)
    n = len(points)
    perplexity = max(5, min(50, n // 5, n - 1))
    d = np.maximum((points**2).sum(1)[:, None] - 2 * points @ points.T + (points**2).sum(1)[None, :], 0)
    low, high, beta = np.zeros(n), np.full(n, np.inf), np.full(n, 1.0 / max(d.mean(), 1e-12))
    for _ in range(60):  # the width of each row's kernel, by bisection on its entropy
        p = np.exp(-(d - np.where(np.eye(n, dtype=bool), np.inf, d).min(1)[:, None]) * beta[:, None])
        np.fill_diagonal(p, 0)
        p /= p.sum(1, keepdims=True)
        entropy = -(p * np.log(np.maximum(p, 1e-300))).sum(1)
        wide = entropy > np.log(min(perplexity, n - 1))
        low, high = np.where(wide, beta, low), np.where(wide, high, beta)
        beta = np.where(np.isinf(high), beta * 2, (low + high) / 2)
    p = (p + p.T) / (2 * n)
    centred = points - points.mean(0)
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    y = centred @ axes[:2].T if len(axes) > 1 else np.column_stack([centred @ axes[0], np.zeros(n)])
    y = y / max(y[:, 0].std(), 1e-12) * 1e-4
    step, rate = np.zeros_like(y), max(n / 48, 10.0)
    for k in range(rounds):
        near = 1 / (1 + np.maximum((y**2).sum(1)[:, None] - 2 * y @ y.T + (y**2).sum(1)[None, :], 0))
        np.fill_diagonal(near, 0)
        force = ((12.0 if k < 250 else 1.0) * p - near / near.sum()) * near
        slope = 4 * (force.sum(1)[:, None] * y - force @ y)
        step = (0.5 if k < 250 else 0.8) * step - rate * slope
        y = y + step
        y -= y.mean(0)
    at = y[back.ravel()]
    return rows.sparkSession.createDataFrame([(r.id, float(a), float(b)) for r, (a, b) in zip(found, at, strict=True)], schema)


def bandwidth(x: np.ndarray, quantile: float = 0.2) -> float:
    """Mean distance to the neighbour at the quantile, on up to ``BANDWIDTH_ROWS`` rows; at least 0.01."""
    x = x[:BANDWIDTH_ROWS]
    d = np.sqrt(np.maximum((x**2).sum(1)[:, None] - 2 * x @ x.T + (x**2).sum(1)[None, :], 0))
    return max(float(np.sort(d, axis=1)[:, max(int(len(x) * quantile) - 1, 0)].mean()), 0.01)


def mean_shift(rows: DataFrame, width: float | None = None, most: int = SAMPLE, rounds: int = 100) -> DataFrame:
    """``rows`` with ``cluster``: modes of the sample under a flat kernel, and every row at the nearest mode."""
    x = sample(rows, most)
    width = width or bandwidth(x)
    at = x.copy()
    for _ in range(rounds):
        d = (at**2).sum(1)[:, None] - 2 * at @ x.T + (x**2).sum(1)[None, :]
        inside = d <= width * width + 1e-12
        moved = (inside @ x) / np.maximum(inside.sum(1), 1)[:, None]
        moved[~inside.any(1)] = at[~inside.any(1)]
        if np.abs(moved - at).max() < 1e-3 * width:
            at = moved
            break
        at = moved
    weight = (((at**2).sum(1)[:, None] - 2 * at @ x.T + (x**2).sum(1)[None, :]) <= width * width + 1e-12).sum(1)
    modes: list[np.ndarray] = []
    for i in np.lexsort((*at.T[::-1], -weight)):
        if all(((at[i] - m) ** 2).sum() > width * width for m in modes):
            modes.append(at[i])
    return nearest(rows, np.stack(modes))
