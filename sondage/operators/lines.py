"""Sums of distances between points that lie on few parallel lines: one feature has many values and the others few combinations, as where a measure stands beside codes of categories.

All pairs are summed without being met one by one. Between two lines at a distance D the distance of two points, sqrt((s - t)² + D²), is analytic in both places, so polynomials through Chebyshev nodes take it up to the
rounding of doubles (``DIGITS``): a line's points become weights at the nodes, distances are worked out between nodes, and the sums at the nodes are read off at each point. On a line itself a point's sum follows from the counts and
sums of what lies below and above it. So the work is some hundred steps a point, and the square of the nodes of all lines; no row is left out and no distance is rounded more than in a sum of all pairs.

What is shuffled is a row a point, once; a task holds a cell, which is a stretch of the lines with about ``CELL`` points. The closer two lines are, the more nodes they need: ``layout`` tells whether that is less work than all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage.sources.staging import Staging

#: Fewest points that are worth the passes, most lines, and points that tell whether there may be so few.
LEAST, MOST_LINES, SAMPLE = 50_000, 2048, 10_000
#: Natural logarithm of the share of a distance that polynomials may be off.
DIGITS = 32
#: What a pair of nodes, and a point at a node, cost in pairs of points.
COST = 4, 8
#: Points of a cell, and most sums by line, cell and cluster, or by line, node and cluster.
CELL, SUMS = 20_000, 1 << 20
#: Most points whose polynomials are worked out at once, most doubles of a matrix, and tasks a core.
STEP, ROOM, WAVES = 1024, 1 << 19, 4


@dataclass
class Layout:
    """The feature along the lines, the other features of each line, the nodes, the bounds of the cells, and the rows of a matrix with a column a node."""

    axis: int
    others: np.ndarray
    nodes: np.ndarray
    bounds: np.ndarray
    step: int

    def places(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(line, place on it) of points."""
        number = {v.tobytes(): i for i, v in enumerate(self.others)}
        rest = np.delete(x, self.axis, 1) + 0.0
        return np.array([number[v.tobytes()] for v in rest], np.int32), x[:, self.axis]

    def basis(self, t: np.ndarray) -> np.ndarray:
        """What each node's value counts for at each place."""
        sign = np.where(np.arange(len(self.nodes)) % 2, -1.0, 1.0)
        sign[[0, -1]] /= 2
        d = t[:, None] - self.nodes
        at, node = np.nonzero(d == 0)
        d[at, node] = 1.0
        out = np.divide(sign, d, out=d)
        out /= out.sum(1, keepdims=True)
        out[at] = 0.0
        out[at, node] = 1.0
        return out


def layout(points: DataFrame, n: int, clusters: int) -> Layout | None:
    """How ``n`` points (x) lie on lines; None where all pairs are less work."""
    if n < LEAST:
        return None
    seen = np.stack(points.select("x").limit(SAMPLE).toPandas()["x"].to_numpy())
    axis = max(range(seen.shape[1]), key=lambda i: len(np.unique(seen[:, i])))
    if len(np.unique(np.delete(seen, axis, 1), axis=0)) > MOST_LINES:
        return None
    rest = F.array(*(F.col("x")[i] for i in range(seen.shape[1]) if i != axis)).cast("array<double>")
    t = F.col("x")[axis]
    found = points.groupBy(rest.alias("rest")).agg(F.min(t).alias("lo"), F.max(t).alias("hi")).limit(MOST_LINES + 1).collect()
    lo, hi = min(r.lo for r in found), max(r.hi for r in found)
    others = np.array([r.rest for r in found], float).reshape(len(found), -1) + 0.0
    if len(found) > MOST_LINES or not lo < hi or not np.isfinite(hi - lo) or not np.isfinite(others).all():
        return None
    apart = math.sqrt(min((float(((others[i + 1 :] - v) ** 2).sum(1).min()) for i, v in enumerate(others[:-1])), default=math.inf))
    # Polynomials of p nodes are off by a factor of exp(-p asinh(D / half the length)).
    half = (hi - lo) / 2
    each = math.asinh(apart / half) if apart < half else 1.0
    p = max(8, math.ceil(DIGITS / each)) if each > 0 else n
    if len(found) * p * clusters > SUMS or COST[0] * (len(found) * p) ** 2 + COST[1] * n * p > n * n:
        return None
    nodes = lo + half * (1 - np.cos(np.pi * np.arange(p) / (p - 1)))
    cells = max(1, min(n // CELL, SUMS // (len(found) * clusters)))
    bounds = points.select(t.alias("t")).approxQuantile("t", [i / cells for i in range(1, cells)], 0.1 / cells) if cells > 1 else []
    return Layout(axis, others, nodes, np.array(bounds, float), max(1, min(STEP, ROOM // p)))


def compare(points: DataFrame, stage: Staging, ids: np.ndarray, give: Callable[[np.ndarray, dict[str, np.ndarray]], pd.DataFrame], schema: str) -> DataFrame | None:
    """The rows that ``give`` makes of points (cluster, n, x) and the sums of their distances to the points of each cluster of ``ids``, ``n`` times each; None where all pairs are less work."""
    plan = layout(points, points.count(), len(ids))
    if plan is None:
        return None
    k, tasks = len(ids), points.sparkSession.sparkContext.defaultParallelism

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                line, t = plan.places(np.stack(pdf["x"].to_numpy()))
                yield pd.DataFrame({"line": line, "cell": np.searchsorted(plan.bounds, t, "right").astype(np.int32), "t": t, "own": np.searchsorted(ids, pdf["cluster"]).astype(np.int32), "n": pdf["n"].to_numpy()})

    dealt = stage.put(points.mapInPandas(deal, "line int, cell int, t double, own int, n long"), "lines")
    lower, upper = _beside(dealt, len(plan.others), len(plan.bounds) + 1, k)
    values = _at_nodes(dealt, plan, k)
    sent = points.sparkSession.sparkContext.broadcast((plan, lower, upper, values))

    def cell(pdf: pd.DataFrame) -> pd.DataFrame:
        plan, lower, upper, values = sent.value
        pdf = pdf.sort_values(["line", "t"])
        line, t, own, n = (pdf[c].to_numpy() for c in ("line", "t", "own", "n"))
        first = np.flatnonzero(np.diff(line, prepend=-1))
        last = np.append(first[1:], len(line))
        stretch = np.repeat(np.arange(len(first)), last - first)
        low, high = (x[line, pdf["cell"].iloc[0]] for x in (lower, upper))
        total = np.empty((len(t), k))
        for c in range(k):
            # Counts and sums of the places up to each point, and of those after it.
            part = np.where(own == c, n, 0).astype(float)[:, None] * np.stack([np.ones(len(t)), t], 1)
            upto = np.cumsum(part, 0)
            upto -= (upto[first] - part[first])[stretch]
            after = upto[last - 1][stretch] - upto + high[:, c]
            upto += low[:, c]
            total[:, c] = t * (upto[:, 0] - after[:, 0]) - (upto[:, 1] - after[:, 1])
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            for i in range(a, b, plan.step):
                j = min(i + plan.step, b)
                total[i:j] += plan.basis(t[i:j]) @ values[line[a]]
        return give(np.maximum(total, 0.0), {"cluster": ids[own], "n": n})

    return dealt.repartition(WAVES * tasks, "cell").groupBy("cell").applyInPandas(cell, schema)


def _beside(dealt: DataFrame, lines: int, cells: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts and sums of places by line, cell and cluster: of the cells below, and of those above."""
    found = dealt.groupBy("line", "cell", "own").agg(F.sum("n").cast("double").alias("w"), F.sum(F.col("n") * F.col("t")).alias("s")).toPandas()
    held = np.zeros((lines, cells, k, 2))
    held[found["line"], found["cell"], found["own"]] = found[["w", "s"]].to_numpy()
    return np.cumsum(held, 1) - held, np.cumsum(held[:, ::-1], 1)[:, ::-1] - held


def _at_nodes(dealt: DataFrame, plan: Layout, k: int) -> np.ndarray:
    """By line, node and cluster: the sums of distances from a node of the line to the points of all other lines."""
    spark, p = dealt.sparkSession, len(plan.nodes)

    def weights(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for pdf in batches:
            at = pdf["line"].to_numpy(np.int64) * k + pdf["own"].to_numpy()
            order = np.argsort(at, kind="stable")
            at, t, n = at[order], pdf["t"].to_numpy()[order], pdf["n"].to_numpy(float)[order]
            for i in range(0, len(at), plan.step):
                here = slice(i, i + plan.step)
                first = np.flatnonzero(np.diff(at[here], prepend=-1))
                for key, x in zip(at[here][first].tolist(), np.add.reduceat(plan.basis(t[here]) * n[here, None], first), strict=True):
                    total[key] = total[key] + x if key in total else x
        if total:
            yield pd.DataFrame({"at": list(total), "x": [x.tobytes() for x in total.values()]})

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"at": pdf["at"].iloc[:1], "x": [np.sum([np.frombuffer(x) for x in pdf["x"]], 0).tobytes()]})

    held = np.zeros((len(plan.others), k, p))
    for r in dealt.mapInPandas(weights, "at long, x binary").groupBy("at").applyInPandas(added, "at long, x binary").collect():
        held[divmod(r.at, k)] = np.frombuffer(r.x)
    sent = spark.sparkContext.broadcast((plan, held))
    parts = -(-p // plan.step)

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plan, held = sent.value
        for pdf in batches:
            for number in pdf["id"].tolist():
                line, part = divmod(number, parts)
                here = plan.nodes[part * plan.step : (part + 1) * plan.step]
                along = (here[:, None] - plan.nodes) ** 2
                apart = ((plan.others - plan.others[line]) ** 2).sum(1)
                room, out = np.empty_like(along), np.zeros((len(here), k))
                for other in np.flatnonzero(apart > 0).tolist():
                    out += np.sqrt(np.add(along, apart[other], out=room), out=room) @ held[other].T
                yield pd.DataFrame({"id": [number], "x": [out.tobytes()]})

    out, count = np.zeros((len(plan.others), p, k)), len(plan.others) * parts
    for r in spark.range(0, count, 1, min(count, WAVES * spark.sparkContext.defaultParallelism)).mapInPandas(meet, "id long, x binary").collect():
        line, part = divmod(r.id, parts)
        out[line, part * plan.step : (part + 1) * plan.step] = np.frombuffer(r.x).reshape(-1, k)
    return out
