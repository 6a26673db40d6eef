"""What a clustering says: quality metrics, sizes, profiles, discriminant features, choice of k, interpretation.

Rows carry ``cluster`` (noise -1) and, for metrics, ``features``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sondage.operators import fits, silhouettes, summary
from sondage.operators.clustering import nearest
from sondage.operators.types import clean, need, number
from sondage.sources.staging import Staging

PROFILE_FEATURES, TOP_FEATURES = 12, 10


def sizes(rows: DataFrame) -> DataFrame:
    """(cluster, n, percent) by cluster."""
    counts = rows.groupBy("cluster").agg(F.count("*").alias("n"))
    return counts.select("cluster", "n", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 1).alias("percent")).orderBy("cluster")


def _long(rows: DataFrame, columns: list[str]) -> DataFrame:
    need(rows, *columns, numeric=True)
    return clean(rows.select("cluster", *(number(c).alias(c) for c in columns))).unpivot(["cluster"], columns, "feature", "x")


def stats(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(cluster, feature, n, mean, std, min, q1, median, q3, max); nulls where a cluster has no values."""
    keys = ["cluster", "feature"]
    long = _long(rows, columns)
    found = Staging(rows.sparkSession, "clusters").put(summary.ranges(long, keys), "ranges")
    out = found.select(*keys).distinct().join(summary.moments(found, keys), keys, "left").join(_quantiles(long, keys, {0.25: "q1", 0.5: "median", 0.75: "q3"}, found), keys, "left")
    r = lambda c, name: F.round(c, 4).alias(name)
    return out.select(*keys, F.coalesce("n", F.lit(0)).alias("n"), r("mean", "mean"), r("std", "std"), r("lo", "min"), r("q1", "q1"), r("median", "median"), r("q3", "q3"), r("hi", "max"))


def _quantiles(rows: DataFrame, keys: list[str], names: dict[float, str], found: DataFrame | None = None, weight: str | None = None) -> DataFrame:
    """(keys..., names...): a column for each probability."""
    values = summary.quantiles(rows, keys, list(names), found, weight)
    return values.groupBy(*keys).agg(*(F.max(F.when(F.col("p") == p, F.col("value"))).alias(name) for p, name in names.items()))


def profiles(rows: DataFrame, columns: list[str], most: int = PROFILE_FEATURES) -> DataFrame:
    """(cluster, feature, value): means of features scaled to [0, 1] over all rows, without noise; 0 for a constant feature."""
    columns = columns[:most]
    if len(columns) < 2:
        raise ValueError("profiles need two features")
    long = _long(rows, columns)
    spread = long.groupBy("feature").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    scaled = F.when(F.col("hi") > F.col("lo"), (F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    return long.where("cluster >= 0").join(F.broadcast(spread), "feature").groupBy("cluster", "feature").agg(F.round(F.avg(scaled), 4).alias("value"))


def discriminant_features(rows: DataFrame, columns: list[str], top: int = TOP_FEATURES) -> DataFrame:
    """(feature, f): the greatest ANOVA F over clusters with more than one value; 0 with fewer than two of them."""
    groups = _long(rows, columns).where("cluster >= 0").groupBy("feature", "cluster").agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v")).where("n > 1")
    total = groups.groupBy("feature").agg(F.sum("n").alias("total"), F.count("*").alias("k"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"), F.sum(F.col("n") * F.col("v")).alias("within"))
    between = groups.join(total.select("feature", "mean"), "feature").groupBy("feature").agg(F.sum(F.col("n") * (F.col("m") - F.col("mean")) * (F.col("m") - F.col("mean"))).alias("between"))
    f = F.try_divide(F.col("between") / F.nullif(F.col("k") - 1, F.lit(0)), F.nullif(F.col("within") / F.nullif(F.col("total") - F.col("k"), F.lit(0)), F.lit(0.0)))
    out = total.join(between, "feature").select("feature", F.round(F.coalesce(F.when(F.col("k") >= 2, f), F.lit(0.0)), 4).alias("f"))
    return out.orderBy(F.desc("f"), "feature").limit(top)


def _moments(rows: DataFrame) -> pd.DataFrame:
    """(cluster, i, n, mean, within) by feature; as many rows as clusters times features."""
    x = rows.where("cluster >= 0").select("cluster", F.posexplode(vector_to_array("features")).alias("i", "x"))
    return x.groupBy("cluster", "i").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), (F.var_pop("x") * F.count("*")).alias("within")).orderBy("cluster", "i").toPandas()


def centres(rows: DataFrame) -> tuple[list[int], np.ndarray, np.ndarray, float]:
    """Clusters, their means, their sizes, and the sum of squares within."""
    m = _moments(rows)
    ids = sorted(m["cluster"].unique().tolist())
    if not ids:
        return [], np.empty((0, 0)), np.empty(0), 0.0
    return ids, np.stack([m[m.cluster == c]["mean"].to_numpy() for c in ids]), np.array([m[m.cluster == c]["n"].iloc[0] for c in ids]), float(m["within"].sum())


def _silhouette(values: DataFrame) -> float:
    return values.agg(F.sum(F.col("silhouette") * F.col("n")) / F.sum("n")).first()[0]


def metrics(rows: DataFrame, kind: str | None = "euclidean", values: DataFrame | None = None) -> dict[str, float | None]:
    """Silhouette, Calinski-Harabasz and Davies-Bouldin without noise; all null with fewer than two clusters.

    ``kind`` is that of ``silhouettes.KINDS``: the work of "euclidean" grows with the square of the distinct rows, that of "squared" with the rows. Null gives no silhouette.
    ``values`` are the silhouettes where they are known already.
    """
    ids, means, n, within = centres(rows)
    k, total = len(ids), n.sum() if len(n) else 0
    if k < 2 or total < k + 1:
        return {"silhouette": None, "calinski_harabasz": None, "davies_bouldin": None}
    grand = (means * n[:, None]).sum(0) / total
    between = float((n * ((means - grand) ** 2).sum(1)).sum())
    ch = between / (k - 1) / (within / (total - k)) if within > 0 else 1.0
    table = rows.sparkSession.createDataFrame([(int(c), [float(v) for v in m]) for c, m in zip(ids, means, strict=True)], "cluster int, c array<double>")
    far = F.sqrt(F.aggregate(F.zip_with(vector_to_array("features"), "c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    spread = {r.cluster: r.s for r in rows.where("cluster >= 0").join(F.broadcast(table), "cluster").groupBy("cluster").agg(F.avg(far).alias("s")).collect()}
    s = np.array([spread[c] for c in ids])
    d = np.sqrt(((means[:, None, :] - means[None, :, :]) ** 2).sum(2))
    ratio = (s[:, None] + s[None, :]) / np.where(d > 0, d, np.inf)
    np.fill_diagonal(ratio, -np.inf)
    return {"silhouette": round(_silhouette(silhouettes.KINDS[kind](rows) if values is None else values), 4) if kind else None, "calinski_harabasz": round(float(ch), 2), "davies_bouldin": round(float(ratio.max(1).mean()), 4)}


def silhouette_table(rows: DataFrame, kind: str = "euclidean") -> DataFrame:
    """(cluster, n, silhouette) of a kind of ``silhouettes.KINDS``, written, so that metrics and summary share one comparison."""
    return Staging(rows.sparkSession, "clusters").put(silhouettes.KINDS[kind](rows), "silhouettes")


def silhouette_summary(rows: DataFrame, kind: str = "euclidean", values: DataFrame | None = None) -> DataFrame:
    """(cluster, n, mean, least, q1, median, q3, greatest) of the silhouettes of a kind of ``silhouettes.KINDS``; ``values`` are the silhouettes where they are known already."""
    values = (silhouette_table(rows, kind) if values is None else values).select("cluster", "n", F.col("silhouette").alias("x"))
    found = values.groupBy("cluster").agg(F.sum("n").alias("n"), (F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("mean"), F.min("x").alias("least"), F.max("x").alias("greatest"))
    found = found.join(_quantiles(values, ["cluster"], {0.25: "q1", 0.5: "median", 0.75: "q3"}, weight="n"), "cluster")
    return found.select("cluster", "n", *(F.round(c, 4).alias(c) for c in ("mean", "least", "q1", "median", "q3", "greatest")))


def elbow(rows: DataFrame, k_max: int, kind: str | None = "squared") -> list[dict]:
    """Inertia and metrics of k-means for k from 2 on; all k are fitted and measured in the same passes.

    ``kind`` is that of ``silhouettes.KINDS``: "squared" needs no pass of its own, "euclidean" compares all distinct rows for each k, null gives no silhouettes.
    """
    points = fits.Points(rows)
    ks = range(2, min(k_max, points.n // 2) + 1)
    models = fits.best_starts(fits.kmeans_starts(points, ks)) if ks else {}
    out = []
    for k, m in (fits.measures(points, models) if ks else {}).items():
        score = m.silhouette
        if score is not None and kind != "squared":
            score = round(_silhouette(silhouettes.KINDS[kind](nearest(rows, models[k] + points.shift))), 4) if kind else None
        out.append({"k": k, "inertia": round(m.inertia, 4), "silhouette": score, "calinski_harabasz": m.calinski_harabasz, "davies_bouldin": m.davies_bouldin})
    points.drop()
    return out


def information_criteria(rows: DataFrame, k_max: int) -> list[dict]:
    """BIC and AIC of full Gaussian mixtures for k from 1 on, fitted in the same passes."""
    points = fits.Points(rows)
    n, d = points.n, points.width
    models = fits.mixtures(points, range(1, min(k_max, max(2, n // 5)) + 1))
    points.drop()
    out = []
    for k, model in models.items():
        free = k - 1 + k * d + k * d * (d + 1) // 2
        out.append({"k": k, "bic": round(free * math.log(n) - 2 * model.likely, 2), "aic": round(2 * free - 2 * model.likely, 2)})
    return out


def best_k(rows: DataFrame, algorithm: str, k_max: int, kind: str = "squared") -> tuple[int | None, list[dict]]:
    """The k of least BIC for mixtures, of greatest k-means silhouette for all others."""
    if algorithm == "gmm":
        table = information_criteria(rows, k_max)
        return min(table, key=lambda r: r["bic"])["k"] if table else None, table
    table = elbow(rows, k_max, kind)
    scored = [r for r in table if r["silhouette"] is not None]
    return max(scored, key=lambda r: r["silhouette"])["k"] if scored else None, table


def notable_features(rows: DataFrame, columns: list[str], top: int = 3, least: float = 0.3) -> DataFrame:
    """(cluster, feature, z, place): each cluster's most unusual feature means, in standard deviations of all rows."""
    long = _long(rows, columns)
    overall = long.groupBy("feature").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd")).where("sd > 0")
    means = long.where("cluster >= 0").groupBy("cluster", "feature").agg(F.avg("x").alias("m")).join(F.broadcast(overall), "feature")
    z = means.select("cluster", "feature", F.round((F.col("m") - F.col("mean")) / F.col("sd"), 4).alias("z")).where(F.abs("z") >= least)
    return z.withColumn("place", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc(F.abs("z")), "feature"))).where(F.col("place") <= top)


def interpretation(rows: DataFrame, columns: list[str], found: dict[str, float | None]) -> list[str]:
    """Sentences on separation, clusters and what to try."""
    counts = {r.cluster: r for r in sizes(rows).collect()}
    k, noise = len([c for c in counts if c >= 0]), counts[-1].percent if -1 in counts else 0.0
    s = found.get("silhouette")
    out = []
    if s is not None:
        band = "strong" if s >= 0.7 else "reasonable" if s >= 0.5 else "weak" if s >= 0.25 else "hardly any"
        out.append(f"The clusters have {band} structure (silhouette {s}).")
    notable: dict[int, list] = {}
    for r in notable_features(rows, columns).orderBy("cluster", "place").collect():
        notable.setdefault(r.cluster, []).append(f"{r.feature} {'high' if r.z > 0 else 'low'} ({r.z:+.2f})")
    for c in sorted(c for c in counts if c >= 0):
        out.append(f"Cluster {c}: {counts[c].n} rows ({counts[c].percent} %): " + (", ".join(notable.get(c, [])) or "near the overall means") + ".")
    if s is not None and s < 0.25:
        out.append("Try another number of clusters or other columns.")
    if noise > 15:
        out.append(f"{noise} % of the rows are noise: try a greater radius.")
    if k == 1:
        out.append("All rows are in one cluster: try a smaller radius or more clusters.")
    if s is not None and s > 0.6:
        out.append("The clusters are well separated.")
    return out
