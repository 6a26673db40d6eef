"""Whole jobs: preparation, clustering and report of a table; the data of the figures; a report as text."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sondage.operators import cluster_report, clustering, correlation, features, importance, profile
from sondage.operators.types import numeric_columns
from sondage.sources.staging import Staging

ALGORITHMS = ("kmeans", "dbscan", "agglomerative", "gmm", "meanshift")


def fit(rows: DataFrame, algorithm: str, **options) -> DataFrame:
    """``rows`` with ``cluster`` by an algorithm of ``ALGORITHMS`` and its options."""
    if algorithm == "kmeans":
        return clustering.kmeans(rows, **options)[0]
    if algorithm == "gmm":
        return clustering.gaussian_mixture(rows, **options)[0]
    if algorithm == "dbscan":
        return clustering.dbscan(rows, **options)
    if algorithm == "agglomerative":
        return clustering.agglomerative(rows, **options)
    if algorithm == "meanshift":
        return clustering.mean_shift(rows, **options)
    raise ValueError(f"algorithm must be one of {ALGORITHMS}")


def cluster(df: DataFrame, columns: list[str], categorical: list[str], algorithm: str, scaler: str = "standard", variance: float | None = None, silhouette: str = "euclidean", **options) -> dict[str, object]:
    """Prepares, fits and reports: rows with ``cluster``, names of the features, metrics, projection, sizes, profiles, statistics,
    discriminant features, silhouettes (of the kind ``silhouette``) and an interpretation."""
    prepared = features.prepare(df, columns, categorical, scaler, variance)
    rows = Staging(df.sparkSession, "job").put(fit(prepared.rows, algorithm, **options), "rows")
    values = cluster_report.silhouette_table(rows, silhouette)
    metrics = cluster_report.metrics(rows, silhouette, values)
    out: dict[str, object] = {
        "rows": rows,
        "features": prepared.names,
        "explained": prepared.explained,
        "metrics": metrics,
        "sizes": cluster_report.sizes(rows),
        "interpretation": cluster_report.interpretation(rows, columns, metrics),
    }
    if columns:
        out |= {"statistics": cluster_report.stats(rows, columns), "discriminant": cluster_report.discriminant_features(rows, columns)}
    if len(columns) >= 2:
        out["profiles"] = cluster_report.profiles(rows, columns)
    if len(prepared.names) >= 2:
        out["projection"] = features.projection_2d(rows)
    if metrics["silhouette"] is not None:
        out["silhouettes"] = cluster_report.silhouette_summary(rows, silhouette, values)
    return out


def figures(df: DataFrame, most_columns: int = 20, most_bars: int = 30) -> dict[str, DataFrame]:
    """The data of the usual figures of a table: missing cells, histograms, boxes, correlations, importance."""
    numeric = numeric_columns(df)[:most_columns]
    out = {"missing": profile.missing_report(df), "importance": importance.top_importance(importance.importance(df), most_bars)}
    out |= {f"histogram {c}": profile.histogram(df, c) for c in numeric}
    out |= {f"box {c}": profile.box_plot(df, c) for c in numeric}
    if len(numeric) > 1:
        out["correlation"] = correlation.matrix(correlation.correlations(df, numeric))
    return out


def report(df: DataFrame, title: str = "Profile") -> str:
    """A Markdown report of a table. Only tables with one row a column are read."""
    table = profile.table_profile(df).first()
    scores = importance.importance(df)
    lines = [f"# {title}", "", f"{table.n_rows} rows, {table.n_columns} columns, {table.completeness} % complete, {table.n_duplicates} duplicates.", ""]

    def add(head: str, rows: DataFrame) -> None:
        lines.extend([f"## {head}", "", "| " + " | ".join(rows.columns) + " |", "| " + " | ".join("---" for _ in rows.columns) + " |"])
        lines.extend("| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in rows.collect())
        lines.append("")

    add("Missing cells", profile.missing_report(df))
    if numeric_columns(df):
        add("Numeric columns", profile.numeric_profile(df))
    if len(numeric_columns(df)) > 1:
        add("Strongest correlations", correlation.ranked_pairs(correlation.correlations(df)).limit(20))
    add("Importance", scores.orderBy("rank"))
    return "\n".join([*lines, *importance.narrative(scores), ""])
