"""K-means and Gaussian mixtures, fitted many at once: each number of clusters and each start is a model, and all models share the passes over the rows.

The vectors are written once. In a pass every task sums what the open models need and gives these sums only, so what is shuffled grows with the models and the tasks, not with the rows. A model that has settled
leaves the passes. Vectors are taken less their overall mean, so that products don't cancel far from the origin. Rows without a vector take no part.

Which rows become candidates of a start depends on the partitions of the written table; a task that is run again chooses the same ones.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage.sources.staging import Staging

SEED, STARTS = 42, 4
#: Rounds in which candidates for centres are drawn, and how many a round and cluster on average.
DRAWS, CANDIDATES = 2, 4
#: A model whose centres all move by less than this share of the rows' spread has settled.
SETTLED = 1e-4
COVARIANCES = ("full", "tied", "diag", "spherical")


def distances(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres."""
    return ((v**2).sum(1)[:, None] - 2 * v @ centres.T + (centres**2).sum(1)[None, :]).clip(0)


def _pieces(flat: np.ndarray, sizes: Iterable[int]) -> list[np.ndarray]:
    return np.split(flat, np.cumsum(list(sizes))[:-1])


class Points:
    """The vectors ``features`` of rows as a written table, with their count, mean and spread. ``passes`` tells how often it was read."""

    def __init__(self, rows: DataFrame) -> None:
        self.stage = Staging(rows.sparkSession, "fits")
        self.x = self.stage.put(rows.where("features is not null").select(vector_to_array("features").alias("x")), "points")
        # Few tasks give few sums; a single one needs no shuffle.
        self.tasks = max(min(self.x.rdd.getNumPartitions(), 4 * rows.sparkSession.sparkContext.defaultParallelism), 1)
        self.passes, self.shift = 0, 0.0
        found = self.sums(lambda v: np.concatenate([[len(v)], v.sum(0)]))
        if not found.size:
            raise ValueError("no rows to fit")
        self.n, self.shift = int(found[0]), found[1:] / found[0]
        #: The sum of squared distances to the mean.
        self.cost = float(self.sums(lambda v: np.array([(v**2).sum()]))[0])

    @property
    def width(self) -> int:
        return len(self.shift)

    def _read(self, task: Callable, schema: str) -> DataFrame:
        self.passes += 1
        return self.x.coalesce(self.tasks).mapInPandas(task, schema)

    def sums(self, work: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The sum over all batches of the vector that ``work`` makes of a matrix of rows; one pass."""
        shift = self.shift

        def task(batches):
            total = None
            for pdf in batches:
                if len(pdf):
                    found = work(np.stack(pdf["x"].to_numpy()) - shift)
                    total = found if total is None else total + found
            if total is not None:
                yield pd.DataFrame({"i": np.arange(total.size), "v": total})

        return self._read(task, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas().sort_values("i")["v"].to_numpy()

    def draw(self, chosen: list[np.ndarray], costs: np.ndarray, wanted: int, seed: int) -> list[np.ndarray]:
        """For each start about ``wanted`` rows, each with a probability that grows with its distance to what is chosen already; one pass."""
        shift = self.shift

        def task(batches):
            random = np.random.default_rng([seed, TaskContext.get().partitionId()])
            for pdf in batches:
                if not len(pdf):
                    continue
                v = np.stack(pdf["x"].to_numpy()) - shift
                for s, centres in enumerate(chosen):
                    taken = random.random(len(v)) * costs[s] < wanted * distances(v, centres).min(1)
                    if taken.any():
                        yield pd.DataFrame({"s": s, "x": list(np.unique(v[taken], axis=0))})

        found = self._read(task, "s int, x array<double>").distinct().orderBy("s", "x").collect()
        return [np.array([r.x for r in found if r.s == s]).reshape(-1, self.width) for s in range(len(chosen))]

    def drop(self) -> None:
        self.stage.drop(self.x)


def _settle(x: np.ndarray, weight: np.ndarray, k: int, random: np.random.Generator, rounds: int = 20) -> np.ndarray:
    """At most ``k`` centres of weighted candidates: drawn one by one by weighted distance, then moved to the means of what is nearest."""
    far, centres = weight, []
    for _ in range(min(k, len(x))):
        if far.sum() <= 0:
            break
        centres.append(x[random.choice(len(x), p=far / far.sum())])
        far = weight * distances(x, np.stack(centres)).min(1)
    centres = np.stack(centres)
    for _ in range(rounds):
        own = distances(x, centres).argmin(1)
        for j in range(len(centres)):
            mine = weight * (own == j)
            if mine.sum() > 0:
                centres[j] = mine @ x / mine.sum()
    return centres


def first_centres(points: Points, ks: Iterable[int], seed: int = SEED) -> dict[tuple[int, int], np.ndarray]:
    """Centres by (k, start), less the mean. Candidates are drawn from all rows in a few passes and weighted by the rows that are nearest; all k of a start share them."""
    ks = sorted(set(ks))
    chosen, costs = [np.zeros((1, points.width))] * STARTS, np.full(STARTS, points.cost)
    if points.cost > 0:
        for i in range(DRAWS):
            new = points.draw(chosen, costs, CANDIDATES * ks[-1], seed * 1000 + i)
            chosen = [np.vstack([a, b]) for a, b in zip(chosen, new, strict=True)]
            if i < DRAWS - 1:
                now = chosen
                costs = points.sums(lambda v: np.array([distances(v, c).min(1).sum() for c in now]))  # noqa: B023
    weights = _pieces(points.sums(lambda v: np.concatenate([np.bincount(distances(v, c).argmin(1), minlength=len(c)).astype(float) for c in chosen])), map(len, chosen))
    return {(k, s): _settle(chosen[s], weights[s], k, np.random.default_rng([seed, k, s])) for k in ks for s in range(STARTS)}


def _assigned(v: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 0/1 matrix of rows and nearest centres, and the squared distances to these."""
    d = distances(v, centres)
    own = d.argmin(1)
    return np.eye(len(centres))[own], d[np.arange(len(v)), own]


def kmeans_starts(points: Points, ks: Iterable[int], seed: int = SEED, rounds: int = 50) -> dict[tuple[int, int], tuple[np.ndarray, float]]:
    """(centres less the mean, cost) by (k, start). A round is one pass for all models that haven't settled."""
    models, d = first_centres(points, ks, seed), points.width
    costs, open_ = dict.fromkeys(models, math.inf), list(models)
    least = SETTLED * math.sqrt(points.cost / points.n)
    for _ in range(rounds):
        now = [models[m] for m in open_]

        def work(v: np.ndarray) -> np.ndarray:
            out = []
            for centres in now:  # noqa: B023
                mine, far = _assigned(v, centres)
                out += [[far.sum()], mine.sum(0), (mine.T @ v).ravel()]
            return np.concatenate(out)

        still = []
        for m, part in zip(open_, _pieces(points.sums(work), [1 + len(c) * (d + 1) for c in now]), strict=True):
            k = len(models[m])
            costs[m], n = float(part[0]), part[1 : 1 + k]
            moved = np.where(n[:, None] > 0, part[1 + k :].reshape(k, d) / np.maximum(n, 1)[:, None], models[m])
            if np.sqrt(((moved - models[m]) ** 2).sum(1)).max() > least:
                still.append(m)
            models[m] = moved
        open_ = still
        if not open_:
            break
    return {m: (models[m], costs[m]) for m in models}


def best_starts(found: dict[tuple[int, int], tuple[np.ndarray, float]]) -> dict[int, np.ndarray]:
    """The centres of the start of least cost by k; ties go to the first start."""
    return {k: found[min((m for m in found if m[0] == k), key=lambda m: (found[m][1], m))][0] for k in sorted({k for k, _ in found})}


@dataclass
class Measures:
    """Quality of an assignment to nearest centres; all but ``inertia`` are null with fewer than two clusters, or with one row a cluster."""

    inertia: float
    silhouette: float | None = None
    calinski_harabasz: float | None = None
    davies_bouldin: float | None = None


def measures(points: Points, models: dict[int, np.ndarray]) -> dict[int, Measures]:
    """By k, from two passes for all models: sums of the clusters, then distances to their means. The silhouette is that of squared distances."""
    d, ks = points.width, list(models)

    def first(v: np.ndarray) -> np.ndarray:
        out = []
        for k in ks:
            mine, far = _assigned(v, models[k])
            out += [[far.sum()], mine.sum(0), mine.T @ (v**2).sum(1), (mine.T @ v).ravel()]
        return np.concatenate(out)

    inertia, sizes, means, spreads = {}, {}, {}, {}
    for k, part in zip(ks, _pieces(points.sums(first), [1 + len(models[k]) * (d + 2) for k in ks]), strict=True):
        c = len(models[k])
        inertia[k], n, squares = float(part[0]), part[1 : 1 + c], part[1 + c : 1 + 2 * c]
        sizes[k], means[k] = n, part[1 + 2 * c :].reshape(c, d) / np.maximum(n, 1)[:, None]
        spreads[k] = np.maximum(squares / np.maximum(n, 1) - (means[k] ** 2).sum(1), 0)

    def second(v: np.ndarray) -> np.ndarray:
        out = []
        for k in ks:
            own, at = distances(v, models[k]).argmin(1), np.arange(len(v))
            far = distances(v, means[k])
            to_own = np.sqrt(far[at, own])
            mean = np.where(sizes[k] > 0, far + spreads[k], np.inf)
            size = sizes[k][own]
            a = mean[at, own] * size / np.maximum(size - 1, 1)
            mean[at, own] = np.inf
            b = mean.min(1)
            top = np.maximum(a, b)
            s = np.where((size > 1) & np.isfinite(b) & (top > 0), (b - a) / np.where((top > 0) & np.isfinite(top), top, 1), 0.0)
            out += [[s.sum()], np.bincount(own, to_own, len(means[k]))]
        return np.concatenate(out)

    out = {}
    for k, part in zip(ks, _pieces(points.sums(second), [1 + len(models[k]) for k in ks]), strict=True):
        held = sizes[k] > 0
        n, m, within = sizes[k][held], means[k][held], float((sizes[k] * spreads[k]).sum())
        out[k] = Measures(inertia[k])
        if len(n) < 2 or points.n < len(n) + 1:
            continue
        between = float((n * (m**2).sum(1)).sum())  # the overall mean is 0
        out[k].silhouette = round(float(part[0]) / points.n, 4)
        out[k].calinski_harabasz = round(between / (len(n) - 1) / (within / (points.n - len(n))), 2) if within > 0 else 1.0
        apart, s = np.sqrt(((m[:, None] - m[None]) ** 2).sum(2)), part[1:][held] / n
        ratio = (s[:, None] + s[None]) / np.where(apart > 0, apart, np.inf)
        np.fill_diagonal(ratio, -np.inf)
        out[k].davies_bouldin = round(float(ratio.max(1).mean()), 4)
    return out


@dataclass
class Mixture:
    """Weights, means (less ``shift``) and covariances of a mixture, and its log likelihood."""

    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    shift: np.ndarray
    likely: float = -math.inf

    def densities(self, v: np.ndarray) -> np.ndarray:
        """Logarithms of the weighted densities of rows less ``shift``."""
        out = np.empty((len(v), len(self.means)))
        for j, (mean, covariance) in enumerate(zip(self.means, self.covariances, strict=True)):
            root = np.linalg.cholesky(covariance)
            z = np.linalg.solve(root, (v - mean).T)
            out[:, j] = np.log(self.weights[j] + 1e-300) - 0.5 * (z**2).sum(0) - np.log(np.diag(root)).sum() - 0.5 * v.shape[1] * math.log(2 * math.pi)
        return out


def _maximised(n: np.ndarray, first: np.ndarray, second: np.ndarray, covariance: str, shift: np.ndarray, likely: float) -> Mixture:
    """The mixture of most likelihood for sums of responsibilities, rows and products."""
    n = np.maximum(n, 1e-12)
    means, weights, one = first / n[:, None], n / n.sum(), np.eye(first.shape[1])
    full = second / n[:, None, None] - np.einsum("ja,jb->jab", means, means)
    if covariance == "tied":
        full = np.stack([np.einsum("j,jab->ab", weights, full)] * len(n))
    elif covariance == "diag":
        full = full * one
    elif covariance == "spherical":
        full = np.stack([one * np.trace(c) / len(one) for c in full])
    return Mixture(weights, means, full + 1e-6 * one, shift, likely)


def mixtures(points: Points, ks: Iterable[int], covariance: str = "full", seed: int = SEED, rounds: int = 100, tolerance: float = 1e-3) -> dict[int, Mixture]:
    """By k the mixture of most likelihood over the starts, each from a k-means. A round is one pass for all models whose log likelihood still grows by ``tolerance`` a row."""
    if covariance not in COVARIANCES:
        raise ValueError(f"covariance must be one of {COVARIANCES}")
    ks, d = sorted(set(ks)), points.width
    centres: dict[tuple[int, int], np.ndarray] = {(1, 0): np.zeros((1, d))} if 1 in ks else {}
    if ks[-1] > 1:
        centres |= {m: c for m, (c, _) in kmeans_starts(points, [k for k in ks if k > 1], seed, 20).items()}
    models: dict[tuple[int, int], Mixture] = {}

    def work(v: np.ndarray, now: list) -> np.ndarray:
        out = []
        for model in now:
            if isinstance(model, Mixture):
                logs = model.densities(v)
                top = logs.max(1, keepdims=True)
                total = top[:, 0] + np.log(np.exp(logs - top).sum(1))
                share, likely = np.exp(logs - total[:, None]), total.sum()
            else:  # the first round takes every row as of its nearest centre
                share, likely = _assigned(v, model)[0], 0.0
            out += [[likely], share.sum(0), (share.T @ v).ravel(), *(((share[:, j : j + 1] * v).T @ v).ravel() for j in range(share.shape[1]))]
        return np.concatenate(out)

    open_ = list(centres)
    for _ in range(rounds):
        now = [models.get(m, centres[m]) for m in open_]
        still = []
        for m, part in zip(open_, _pieces(points.sums(lambda v: work(v, now)), [1 + len(centres[m]) * (1 + d + d * d) for m in open_]), strict=True):  # noqa: B023
            k, before = len(centres[m]), models.get(m)
            likely = float(part[0]) if before else -math.inf
            if before and likely - before.likely < tolerance * points.n:
                before.likely = likely
                continue
            first, second = part[1 + k : 1 + k + k * d].reshape(k, d), part[1 + k + k * d :].reshape(k, d, d)
            models[m] = _maximised(part[1 : 1 + k], first, second, covariance, points.shift, likely)
            still.append(m)
        open_ = still
        if not open_:
            break
    return {k: max((models[m] for m in sorted(models) if m[0] == k), key=lambda f: f.likely) for k in ks}
