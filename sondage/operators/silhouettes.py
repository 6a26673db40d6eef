"""Silhouettes of all rows with ``cluster`` and ``features``; noise (-1) is left out.

``euclidean`` is the common definition: a row's mean distances to all rows of each cluster. Points on few parallel lines are summed along them (``lines``); elsewhere the arithmetic grows with the square of the distinct
rows, while what is shuffled and written grows with the rows. ``squared`` takes squared distances, whose means follow from each cluster's size, mean and scatter: one pass, the form for large tables.
Both give (cluster, n, silhouette), in which ``n`` equal rows of a cluster are one, so that copies cost nothing. A row alone in its cluster has 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage.operators import lines, pairs
from sondage.sources.staging import Staging

#: Most points of a block, and most sums of distances by point and cluster that a task keeps for it, as long as it has 64 points.
BLOCK, SUMS = 8192, 1 << 20


def _points(rows: DataFrame) -> DataFrame:
    return rows.where("cluster >= 0").groupBy("cluster", vector_to_array("features").alias("x")).agg(F.count("*").alias("n"))


def euclidean(rows: DataFrame) -> DataFrame:
    """Each task sums the distances of its own points to all others by cluster, so that only a row a point leaves the comparison."""
    stage = Staging(rows.sparkSession, "silhouettes")
    points = stage.put(_points(rows).select("cluster", "n", "x"), "points")
    sizes = points.groupBy("cluster").agg(F.sum("n").alias("size")).orderBy("cluster").toPandas()
    ids, size = sizes["cluster"].to_numpy(np.int64), sizes["size"].to_numpy(float)
    if len(ids) < 2:
        return points.select("cluster", "n", F.lit(0.0).alias("silhouette"))
    def start(own: pairs.Block) -> np.ndarray:
        return np.zeros((len(own["x"]), len(ids)))

    def meet(total: np.ndarray, own: pairs.Block, other: pairs.Block) -> None:
        # In order of cluster, so that a tile has few of them.
        order = np.argsort(other["cluster"], kind="stable")
        group, weight = np.searchsorted(ids, other["cluster"][order]), other["n"][order]
        for at, columns, d, _ in pairs.tiles(own["x"], other["x"][order]):
            low, high = group[columns.start], group[columns.stop - 1] + 1
            member = np.zeros((columns.stop - columns.start, high - low))
            member[np.arange(len(member)), group[columns] - low] = weight[columns]
            total[at, low:high] += np.sqrt(d, out=d) @ member

    def give(total: np.ndarray, own: pairs.Block) -> pd.DataFrame:
        group, at = np.searchsorted(ids, own["cluster"]), np.arange(len(total))
        a = np.where(size[group] > 1, total[at, group] / np.maximum(size[group] - 1, 1), np.nan)
        means = total / size
        means[at, group] = np.inf
        return pd.DataFrame({"cluster": own["cluster"], "n": own["n"], "a": a, "b": means.min(1)})

    schema = "cluster int, n long, a double, b double"
    found = lines.compare(points, stage, ids, give, schema)
    if found is None:
        blocks = pairs.packed(points, stage, ["cluster", "n"], min(BLOCK, max(64, SUMS // len(ids))))
        found = pairs.compare(blocks, blocks, start, meet, give, schema)
    return found.select("cluster", "n", _score(F.nanvl("a", F.lit(None)), F.col("b")).alias("silhouette"))


def squared(rows: DataFrame) -> DataFrame:
    """The driver sees a row for each cluster and feature."""
    long = rows.where("cluster >= 0").select("cluster", F.posexplode(vector_to_array("features")).alias("i", "x"))
    found = long.groupBy("cluster", "i").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("v")).orderBy("cluster", "i").toPandas()
    ids = np.sort(found["cluster"].unique())
    if not len(ids):
        return rows.sparkSession.createDataFrame([], "cluster int, n long, silhouette double")
    centres = found["mean"].to_numpy(float).reshape(len(ids), -1)
    spread = found.groupby("cluster")["v"].sum().to_numpy(float)
    size = found.groupby("cluster")["n"].first().to_numpy(float)

    def means(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x, own, at = np.stack(pdf["x"].to_numpy()), np.searchsorted(ids, pdf["cluster"].to_numpy()), np.arange(len(pdf))
            d = np.stack([((x - c) ** 2).sum(1) for c in centres], 1) + spread
            a = np.where(size[own] > 1, d[at, own] * size[own] / np.maximum(size[own] - 1, 1), np.nan)
            d[at, own] = np.inf
            b = d.min(1)
            yield pd.DataFrame({"cluster": pdf["cluster"], "n": pdf["n"], "a": a, "b": np.where(np.isfinite(b), b, np.nan)})

    found = _points(rows).mapInPandas(means, "cluster int, n long, a double, b double")
    return found.select("cluster", "n", _score(F.nanvl("a", F.lit(None)), F.nanvl("b", F.lit(None))).alias("silhouette"))


def _score(a: F.Column, b: F.Column) -> F.Column:
    """0 where one of the two is missing or both are 0."""
    top = F.greatest(a, b)
    return F.when(a.isNotNull() & b.isNotNull() & (top > 0), (b - a) / F.nullif(top, F.lit(0.0))).otherwise(0.0)


KINDS = {"euclidean": euclidean, "squared": squared}
