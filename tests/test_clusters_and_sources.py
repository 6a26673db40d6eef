"""Clusterings on blobs, degenerate data, sources, catalog and streams."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondage.operators import cluster_report, clustering, features, jobs, silhouettes
from sondage.sources import catalog, delimited
from sondage.streaming.profile import windowed_profile

NUMBERS = [f"num_{i}" for i in range(5)]


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.RandomState(42)
    centres = np.array([[-8, -8, 0, 0, 3], [8, 8, 0, 0, -3], [-8, 8, 6, 0, 0], [8, -8, 0, 6, 0]], float)
    kind = np.arange(300) % 4
    x = centres[kind] + rng.normal(0, 1.2, (300, 5))
    letters = np.random.RandomState(0).choice(["A", "B", "C"], 300)
    rows = [(i, int(kind[i]), *map(float, x[i]), str(letters[i])) for i in range(300)]
    return spark.createDataFrame(rows, "id long, kind int, " + ", ".join(f"{c} double" for c in NUMBERS) + ", categorie string").cache()


@pytest.fixture(scope="module")
def prepared(blobs):
    found = features.prepare(blobs, NUMBERS)
    return found.rows.cache()


def agreement(rows):
    """Share of rows whose cluster is that of most rows of their kind, under the best naming."""
    counts = {(r.kind, r.cluster): r["count"] for r in rows.groupBy("kind", "cluster").count().collect()}
    clusters = sorted({c for _, c in counts})
    best = 0
    for naming in itertools.permutations([*clusters, *[None] * 4], 4):
        best = max(best, sum(counts.get((k, c), 0) for k, c in enumerate(naming)))
    return best / sum(counts.values())


@pytest.mark.parametrize(
    "fit",
    [
        lambda p: clustering.kmeans(p, 4)[0],
        lambda p: clustering.gaussian_mixture(p, 4)[0],
        lambda p: clustering.gaussian_mixture(p, 4, "tied")[0],
        lambda p: clustering.gaussian_mixture(p, 4, "diag")[0],
        lambda p: clustering.gaussian_mixture(p, 4, "spherical")[0],
        lambda p: clustering.dbscan(p, "id", 1.0, 5),
        lambda p: clustering.agglomerative(p, 4),
        lambda p: clustering.agglomerative(p, 4, "average"),
        lambda p: clustering.mean_shift(p, 1.5),
    ],
)
def test_blobs(prepared, fit):
    out = fit(prepared)
    assert out.count() == 300 and agreement(out) > 0.97


def test_dbscan_against_brute_force(spark):
    rng = np.random.RandomState(5)
    x = np.concatenate([rng.normal(0, 0.3, (60, 3)), rng.normal(2, 0.3, (60, 3)), rng.uniform(-3, 5, (40, 3))])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
    got = {r.id: r.cluster for r in clustering.dbscan(features.from_array(df, "v"), "id", 0.4, 5).collect()}
    near = ((x[:, None] - x[None]) ** 2).sum(2) <= 0.16
    core = near.sum(1) >= 5
    label = np.full(len(x), -1)
    k = 0
    for i in np.flatnonzero(core):
        if label[i] < 0:
            todo = [i]
            label[i] = k
            while todo:
                for j in np.flatnonzero(near[todo.pop()] & core):
                    if label[j] < 0:
                        label[j] = k
                        todo.append(j)
            k += 1
    for i in np.flatnonzero(~core):
        if (near[i] & core).any():
            label[i] = label[np.flatnonzero(near[i] & core)[0]]
    assert [got[i] for i in range(len(x))] == label.tolist()


def test_hierarchy(prepared):
    x = np.array([[0.0], [1.0], [5.0], [7.0], [20.0]])
    tree = clustering.merges(x, "single")
    assert tree[:, 2].tolist() == [1.0, 2.0, 4.0, 13.0] and tree[-1, 3] == 5
    assert clustering.merges(x, "ward")[0].tolist() == [0, 1, 1.0, 2]
    assert len(set(clustering.cut(tree, 5, 2))) == 2
    assert clustering.dendrogram(prepared, 100).count() == 99
    with pytest.raises(ValueError):
        clustering.merges(x, "other")


def test_metrics_and_choice(prepared):
    truth = prepared.withColumn("cluster", F.col("kind"))
    found = cluster_report.metrics(truth)
    x = np.array([r.features.toArray() for r in truth.orderBy("id").collect()])
    kind = np.array([r.kind for r in truth.orderBy("id").collect()])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    s = []
    for i in range(300):
        a = d[i][kind == kind[i]].sum() / ((kind == kind[i]).sum() - 1)
        b = min(d[i][kind == k].mean() for k in range(4) if k != kind[i])
        s.append((b - a) / max(a, b))
    assert found["silhouette"] == pytest.approx(np.mean(s), abs=1e-3)
    assert found["calinski_harabasz"] > 100 and found["davies_bouldin"] < 1
    assert cluster_report.best_k(prepared, "kmeans", 6)[0] == 4
    assert cluster_report.best_k(prepared, "gmm", 5)[0] == 4
    sizes = cluster_report.sizes(truth).collect()
    assert [(r.cluster, r.n, r.percent) for r in sizes] == [(k, 75, 25.0) for k in range(4)]
    assert cluster_report.discriminant_features(truth, NUMBERS).first().f > 100
    text = cluster_report.interpretation(truth, NUMBERS, found)
    assert any(t.startswith("Cluster 0") for t in text)
    assert cluster_report.profiles(truth, NUMBERS).count() == 20
    assert cluster_report.silhouette_summary(truth).count() == 4


@pytest.mark.parametrize("kind", ["euclidean", "squared"])
def test_silhouettes_of_all_rows(spark, kind, monkeypatch):
    """Against all pairs, over several blocks, with repeated rows, noise and a row alone in its cluster."""
    monkeypatch.setattr(silhouettes, "BLOCK", 7)
    x = np.random.default_rng(5).integers(0, 6, (90, 2)).astype(float)
    c = np.array([-1, 7] + [i % 3 for i in range(88)])
    rows = features.from_array(spark.createDataFrame([(int(k), v.tolist()) for k, v in zip(c, x)], "cluster int, v array<double>"), "v")
    x, c = x[c >= 0], c[c >= 0]
    d = ((x[:, None] - x[None]) ** 2).sum(2) ** (0.5 if kind == "euclidean" else 1)
    wanted = []
    for i, k in enumerate(c):
        a = d[i][c == k].sum() / max((c == k).sum() - 1, 1)
        b = min(d[i][c == o].mean() for o in set(c.tolist()) - {k})
        wanted.append((b - a) / max(a, b) if (c == k).sum() > 1 else 0.0)
    found = silhouettes.KINDS[kind](rows).collect()
    got = sorted(v for r in found for v in [round(r.silhouette, 6)] * r.n)
    assert got == pytest.approx(sorted(wanted), abs=1e-5)
    assert silhouettes.KINDS[kind](rows.where("cluster = 7")).first().silhouette == 0.0
    assert silhouettes.KINDS[kind](rows.where("cluster < -1")).count() == 0


def shuffled(spark, work):
    """Rows that ``work`` writes to shuffles."""
    store, to_java = spark.sparkContext._jsc.sc().statusStore(), spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava
    rows = lambda: sum(s.shuffleWriteRecords() for s in to_java(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)))
    before = rows()
    work()
    return rows() - before


def test_silhouettes_shuffle_points_not_pairs(spark, monkeypatch):
    """Four times the points are at most five times the rows in shuffles; blocks are small, so that pairs of blocks would be many more."""
    monkeypatch.setattr(silhouettes, "BLOCK", 8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        points = lambda n: features.from_array(spark.range(n).selectExpr("cast(id % 3 as int) AS cluster", "array(cast(id as double), cast(id % 7 as double)) AS v"), "v")
        few, many = (shuffled(spark, lambda n=n: silhouettes.euclidean(points(n)).count()) for n in (400, 1600))
        assert many <= 5 * few
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_job_compares_its_rows_once(blobs, monkeypatch):
    calls = []
    monkeypatch.setitem(silhouettes.KINDS, "euclidean", lambda rows: calls.append(1) or silhouettes.euclidean(rows))
    found = jobs.cluster(blobs, NUMBERS[:2], [], "kmeans", k=3)
    assert calls == [1] and found["metrics"]["silhouette"] is not None and found["silhouettes"].count() == 3


def test_preparation(spark, blobs):
    found = features.prepare(blobs, ["num_0", "num_1"], ["categorie"], "minmax")
    assert found.names == ["num_0", "num_1", "categorie_A", "categorie_B", "categorie_C"]
    assert max(max(r.features) for r in found.rows.collect()) == 1.0
    reduced = features.prepare(blobs, NUMBERS, variance=0.8)
    assert len(reduced.rows.first().features) < 5
    with pytest.raises(ValueError):
        features.prepare(blobs, NUMBERS, scaler="none")
    with pytest.raises(ValueError):
        features.prepare(blobs, NUMBERS, variance=1.0)
    many = spark.createDataFrame([(f"v{i % 30:02d}",) for i in range(100)] + [(None,)], "c string")
    _, names = features.encoded(many, ["c"])
    assert len(names) == 20 and "c___autre__" in names
    holes = features.scaled(spark.createDataFrame([(1.0, None), (None, None), (3.0, None)], "a double, b double"), ["a", "b"]).collect()
    assert [r.b for r in holes] == [0.0] * 3 and holes[1].a == 0.0
    xy = features.projection_2d(found.rows)
    assert xy.agg(F.avg("pc_1")).first()[0] == pytest.approx(0, abs=1e-9)


def test_degenerate(spark):
    df = spark.createDataFrame([(i, *[0.0] * 6) for i in range(250)], "id long, " + ", ".join(f"const_{i} double" for i in range(6)))
    rows = features.prepare(df, [f"const_{i}" for i in range(6)]).rows
    for out in (clustering.kmeans(rows, 3)[0], clustering.agglomerative(rows, 3), clustering.mean_shift(rows), clustering.dbscan(rows.limit(40), "id", 0.5)):
        found = cluster_report.metrics(out)
        assert found["silhouette"] is None or -1 <= found["silhouette"] <= 1
    assert cluster_report.discriminant_features(rows.withColumn("cluster", F.lit(0)), ["const_0"]).first().f == 0


def write(path, data: bytes):
    path.write_bytes(data)
    return str(path)


def test_delimited(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'id;name;x\n1;"a;b";1.5\n\n2;c\n3;d;2;9;9\n4;é\xff;NA\n5;f;3;8\n'.encode("latin-1"))
    found = delimited.scan(spark, path)
    assert found.delimiter == ";"
    rows = found.rows.orderBy("id").collect()
    assert [(r.id, r.x) for r in rows] == [(1, 1.5), (2, None), (4, None)] and rows[0].name == "a;b"
    assert found.rows.dtypes == [("id", "bigint"), ("name", "string"), ("x", "double")]
    assert sorted((r.raw, r.n_fields, r.n_expected) for r in found.rejected.collect()) == [("3;d;2;9;9", 5, 3), ("5;f;3;8", 4, 3)]
    assert delimited.scan_report(found).first().n_rejected == 2
    for sep in ",\t|":
        p = write(tmp_path / f"b{ord(sep)}.csv", f"a{sep}b\n1{sep}true\n2{sep}false\n".encode())
        assert delimited.detect_delimiter(spark, p) == sep
        assert delimited.scan(spark, p).rows.dtypes == [("a", "bigint"), ("b", "boolean")]
    with pytest.raises(delimited.Rejected):
        delimited.detect_delimiter(spark, write(tmp_path / "e.csv", b"\n \n"))
    with pytest.raises(delimited.Rejected):
        delimited.gate(spark, write(tmp_path / "e.txt", b"x"))
    with pytest.raises(delimited.Rejected):
        delimited.gate(spark, path, 10)
    with pytest.raises(delimited.Rejected):
        delimited.gate(spark, str(tmp_path / "none.csv"))


def test_catalog(spark, tmp_path):
    store = catalog.Catalog(spark, str(tmp_path / "store"))
    assert store.entries().collect() == []
    a = store.save(spark.range(3).toDF("x"), "a.csv", names={"x": "VAR_01"})
    b = store.save(spark.range(2).toDF("x"), "b.csv", parent_id=a, journal=["drop_duplicates"])
    assert [r.dataset_id for r in store.entries().collect()] == [b, a]
    assert store.lineage(b) == [b, a] and store.describe(b)["journal"] == ["drop_duplicates"] and store.load(a).count() == 3
    store.save_keys(spark.createDataFrame([("v", "ID_1")], "value string, pseudonym string"), a)
    assert store.keys(a).collect()[0].pseudonym == "ID_1" and store.keys(b).count() == 0
    store.delete(b)
    assert not store.exists(b) and len(store.entries().collect()) == 1
    with pytest.raises(catalog.UnknownDataset):
        store.load(b)


def test_stream_is_the_table(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "events"))
    stream = windowed_profile(spark.readStream.schema(events.schema).parquet(str(tmp_path / "events")), "ts", "event_type", "value", "1 day", "400 days")
    q = stream.writeStream.format("memory").queryName("profiled").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    key = lambda rows: sorted((r.start, r.event_type, r.n, round(r["mean"], 6), r["min"], r["max"]) for r in rows)
    assert key(spark.table("profiled").collect()) == key(windowed_profile(events, "ts", "event_type", "value", "1 day").collect())
