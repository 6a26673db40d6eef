"""The dataset object, whole jobs and the embedding."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondage.dataset import Dataset
from sondage.operators import clustering, features, jobs


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.RandomState(2)
    rows = [(i, float(rng.normal(i % 3 * 10, 1)), float(rng.normal(i % 3 * -5, 1)), "ABC"[i % 3], None if i % 4 == 0 else "x") for i in range(120)]
    return Dataset(spark.createDataFrame(rows, "id long, a double, b double, kind string, hole string").cache())


def test_dataset(data):
    assert data.overview().first().n_rows == 120
    assert data.columns().count() == 5 and data.missing().first()["column"] == "hole"
    assert data.column_lists() == {"numeric": ["id", "a", "b"], "text": ["kind", "hole"]}
    assert set(data.numeric("a")) == {"statistics", "histogram", "box", "outliers", "alerts"}
    assert {r.value: r.times for r in data.categorical("kind").collect()} == {"A": 40, "B": 40, "C": 40}
    assert data.normality_of("a")["line"].first().slope > 0
    assert data.correlations().first().strength > 0.9
    assert data.importance(2).count() == 2 and data.variable("a").count() == 4
    assert data.fitness().first().status == "ok" and data.algorithms().count() == 5 and data.encoding_plan().count() == 2
    after = data.apply(["impute_moderate_missing", "standardize"])
    assert after.journal == ["mode filled in: hole (x)", "standardised: 3 columns"] and after.overview().first().n_missing == 0
    assert {r.measure: r.change for r in data.compare(after).collect()}["n_missing"] == "-30.00"
    hidden, log = data.anonymised("s", {"kind": "name"})
    assert hidden.df.first().kind.startswith("ID_") and log.count() == 5
    assert dict(data.recommendations())["impute_moderate_missing"]
    assert data.dendrogram(["a", "b"], most=50).count() == 49
    assert data.best_k("kmeans", ["a", "b"], k_max=4)[0] == 3
    text = data.report("Try")
    assert text.startswith("# Try") and "| hole | 30 |" in text
    assert {"missing", "importance", "correlation", "histogram a", "box b"} <= set(data.figures())


def test_cluster_job(data):
    found = data.cluster("kmeans", ["a", "b"], ["kind"], k=3)
    assert found["features"] == ["a", "b", "kind_A", "kind_B", "kind_C"] and found["metrics"]["silhouette"] > 0.7
    assert {"sizes", "statistics", "discriminant", "profiles", "projection", "silhouettes"} <= set(found)
    with pytest.raises(ValueError):
        jobs.fit(found["rows"].drop("cluster"), "none")


def test_embedding(spark, data):
    rows = features.prepare(data.df, ["a", "b"]).rows
    found = clustering.tsne(rows, "id").join(data.df, "id").toPandas()
    assert len(found) == 120
    at = found[["x", "y"]].to_numpy()
    d = ((at[:, None] - at[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    assert (found.kind.to_numpy()[d.argmin(1)] == found.kind.to_numpy()).mean() > 0.95
    assert clustering.tsne(rows.withColumn("features", F.lit(None).cast(rows.schema["features"].dataType)).where("id < 0"), "id").collect() == []
