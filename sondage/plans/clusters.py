"""Feature preparation, clusterings and their reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage.operators import cluster_report, clustering, features, jobs
from sondage.plans.base import query, table

COLUMNS = [f"e{i}" for i in range(4)]
#: The first four parts of the vectors, with the given labels.
_EMBEDDED = "(SELECT vec_id, label AS cluster, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS e{i}" for i in range(4)) + " FROM embeddings)"


def embedded(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("cluster"), *(F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(4)))


def vectors(spark, sf_dir) -> DataFrame:
    return features.from_array(table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("cluster"), "embedding"), "embedding")


@query("cluster_sizes", "SELECT label AS cluster, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 1) AS percent FROM embeddings GROUP BY 1")
def cluster_sizes(spark, sf_dir):
    return cluster_report.sizes(embedded(spark, sf_dir))


_STATS = "SELECT cluster, '{c}' AS feature, count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, round(quantile_cont({c}, 0.25), 4) AS q1, round(quantile_cont({c}, 0.5), 4) AS median, round(quantile_cont({c}, 0.75), 4) AS q3, round(max({c}), 4) AS max FROM " + _EMBEDDED + " GROUP BY cluster"


@query("cluster_stats", " UNION ALL ".join(_STATS.replace("{c}", c) for c in COLUMNS))
def cluster_stats(spark, sf_dir):
    return cluster_report.stats(embedded(spark, sf_dir), COLUMNS)


_PROFILE = f"SELECT cluster, '{{c}}' AS feature, round(avg(({{c}} - lo) / (hi - lo)), 4) AS value FROM {_EMBEDDED}, (SELECT min({{c}}) lo, max({{c}}) hi FROM {_EMBEDDED}) GROUP BY cluster"


@query("cluster_profiles", " UNION ALL ".join(_PROFILE.replace("{c}", c) for c in COLUMNS))
def cluster_profiles(spark, sf_dir):
    return cluster_report.profiles(embedded(spark, sf_dir), COLUMNS)


_F = f"SELECT '{{c}}' AS feature, (sum(n * power(m - g, 2)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) AS f FROM (SELECT count(*) n, avg({{c}}) m, var_pop({{c}}) v FROM {_EMBEDDED} GROUP BY cluster HAVING count(*) > 1), (SELECT avg({{c}}) g FROM (SELECT {{c}}, count(*) OVER (PARTITION BY cluster) k FROM {_EMBEDDED}) WHERE k > 1)"


@query("anova_f", "SELECT feature, round(f, 4) AS f FROM (" + " UNION ALL ".join(_F.replace("{c}", c) for c in COLUMNS) + ")")
def anova_f(spark, sf_dir):
    return cluster_report.discriminant_features(embedded(spark, sf_dir), COLUMNS)


_LONG = "(SELECT vec_id, label AS cluster, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)"
_CENTRES = f"(SELECT cluster, i, avg(x) AS c, count(*) AS n, var_pop(x) * count(*) AS w FROM {_LONG} GROUP BY 1, 2)"


@query("calinski_davies", f"""WITH m AS {_CENTRES}, g AS (SELECT i, sum(n * c) / sum(n) AS g FROM m GROUP BY i), k AS (SELECT count(DISTINCT cluster) AS k FROM m), t AS (SELECT count(*) AS t FROM embeddings),
 ch AS (SELECT sum(n * power(c - g, 2)) / (max(k) - 1) / (sum(w) / (max(t) - max(k))) AS ch FROM m JOIN g USING (i), k, t),
 d AS (SELECT l.vec_id, l.cluster, sqrt(sum(power(l.x - m.c, 2))) AS d FROM {_LONG} l JOIN m ON m.cluster = l.cluster AND m.i = l.i GROUP BY 1, 2), s AS (SELECT cluster, avg(d) AS s FROM d GROUP BY 1),
 p AS (SELECT a.cluster AS a, b.cluster AS b, sqrt(sum(power(a.c - b.c, 2))) AS d FROM m a JOIN m b ON a.i = b.i AND a.cluster <> b.cluster GROUP BY 1, 2),
 r AS (SELECT a, max((x.s + y.s) / d) AS r FROM p JOIN s x ON x.cluster = a JOIN s y ON y.cluster = b GROUP BY a)
 SELECT round((SELECT ch FROM ch), 2) AS calinski_harabasz, round((SELECT avg(r) FROM r), 4) AS davies_bouldin""")
def calinski_davies(spark, sf_dir):
    found = cluster_report.metrics(vectors(spark, sf_dir), None)
    return spark.createDataFrame([(found["calinski_harabasz"], found["davies_bouldin"])], "calinski_harabasz double, davies_bouldin double")


_Z = f"SELECT cluster, '{{c}}' AS feature, round((avg({{c}}) - m) / s, 4) AS z FROM {_EMBEDDED}, (SELECT avg({{c}}) m, stddev_samp({{c}}) s FROM {_EMBEDDED}) GROUP BY cluster, m, s"


@query("notable_features", "WITH z AS (" + " UNION ALL ".join(_Z.replace("{c}", c) for c in COLUMNS) + ") SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY abs(z) DESC, feature)::INT AS place FROM z WHERE abs(z) >= 0.3) WHERE place <= 3")
def notable_features(spark, sf_dir):
    return cluster_report.notable_features(embedded(spark, sf_dir), COLUMNS)


#: (cluster, s) of each row from ``m``: a row's mean distance to its own cluster and to the nearest other one.
_SUMMARY = """v AS (SELECT own AS cluster, CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) = 0 THEN 0.0 ELSE (b - a) / greatest(a, b) END AS s FROM m)
 SELECT cluster, count(*) AS n, round(avg(s), 4) AS mean, round(min(s), 4) AS least, round(quantile_cont(s, 0.25), 4) AS q1, round(quantile_cont(s, 0.5), 4) AS median, round(quantile_cont(s, 0.75), 4) AS q3, round(max(s), 4) AS greatest FROM v GROUP BY cluster"""


def _silhouette_sql(distance: str) -> str:
    """By the definition: all pairs of rows."""
    return f"""WITH p AS (SELECT vec_id, label AS cluster, embedding::DOUBLE[] AS x FROM embeddings), s AS (SELECT cluster, count(*) AS size FROM p GROUP BY 1),
 d AS (SELECT a.vec_id, a.cluster AS own, b.cluster AS c, sum({distance}) AS total FROM p a, p b GROUP BY 1, 2, 3),
 m AS (SELECT vec_id, own, max(CASE WHEN c = own AND size > 1 THEN total / (size - 1) END) AS a, min(CASE WHEN c <> own THEN total / size END) AS b FROM d JOIN s ON s.cluster = d.c GROUP BY 1, 2), """ + _SUMMARY


@query("silhouette", _silhouette_sql("list_distance(a.x, b.x)"))
def silhouette(spark, sf_dir):
    return cluster_report.silhouette_summary(vectors(spark, sf_dir))


@query("silhouette_squared", _silhouette_sql("power(list_distance(a.x, b.x), 2)"))
def silhouette_squared(spark, sf_dir):
    return cluster_report.silhouette_summary(vectors(spark, sf_dir), "squared")


@query("interpretation")
def interpretation(spark, sf_dir):
    rows = features.from_array(table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("cluster"), "embedding", *(F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(4))), "embedding")
    return spark.createDataFrame(list(enumerate(cluster_report.interpretation(rows, COLUMNS, cluster_report.metrics(rows)))), "position int, sentence string")


@query("one_hot_features", "SELECT o_orderkey, (o_orderstatus = 'F')::DOUBLE AS \"o_orderstatus_F\", (o_orderstatus = 'O')::DOUBLE AS \"o_orderstatus_O\" FROM orders")
def one_hot_features(spark, sf_dir):
    return features.encoded(table(spark, sf_dir, "orders"), ["o_orderstatus"])[0].select("o_orderkey", "o_orderstatus_F", "o_orderstatus_O")


@query("collapsed_values", "WITH t AS (SELECT p_type, row_number() OVER (ORDER BY count(*) DESC, p_type) AS k, count(*) OVER () AS d FROM part GROUP BY 1) SELECT p_partkey, CASE WHEN d > 20 AND k > 19 THEN '__autre__' ELSE part.p_type END AS p_type FROM part JOIN t ON part.p_type = t.p_type")
def collapsed_values(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", features.collapsed(part, "p_type").alias("p_type"))


def _scaled(spark, sf_dir, scaler: str) -> DataFrame:
    return features.scaled(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"], scaler).select("c_custkey", F.round("c_acctbal", 6).alias("c_acctbal"))


@query("scale_standard", "SELECT c_custkey, round((c_acctbal - m) / s, 6) AS c_acctbal FROM customer, (SELECT avg(c_acctbal) m, stddev_pop(c_acctbal) s FROM customer)")
def scale_standard(spark, sf_dir):
    return _scaled(spark, sf_dir, "standard")


@query("scale_robust", "SELECT c_custkey, round((c_acctbal - m) / s, 6) AS c_acctbal FROM customer, (SELECT quantile_cont(c_acctbal, 0.5) m, quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25) s FROM customer)")
def scale_robust(spark, sf_dir):
    return _scaled(spark, sf_dir, "robust")


@query("scale_minmax", "SELECT c_custkey, round((c_acctbal - m) / s, 6) AS c_acctbal FROM customer, (SELECT min(c_acctbal) m, max(c_acctbal) - min(c_acctbal) s FROM customer)")
def scale_minmax(spark, sf_dir):
    return _scaled(spark, sf_dir, "minmax")


def _labels(rows: DataFrame) -> DataFrame:
    return clustering.relabelled(rows).select("vec_id", "cluster")


def _plain(spark, sf_dir) -> DataFrame:
    return vectors(spark, sf_dir).drop("cluster", "embedding")


@query("kmeans")
def kmeans(spark, sf_dir):
    return _labels(clustering.kmeans(_plain(spark, sf_dir), 4)[0])


@query("gmm")
def gmm(spark, sf_dir):
    return _labels(clustering.gaussian_mixture(features.reduced(_plain(spark, sf_dir), 3), 4)[0])


@query("gmm_diag")
def gmm_diag(spark, sf_dir):
    return _labels(clustering.gaussian_mixture(features.reduced(_plain(spark, sf_dir), 3), 4, "diag")[0])


def _dbscan_sql(points: str, key: str, eps: float, least: int) -> str:
    """By the definition, from points (id, x): neighbours of all pairs, components of core points by reachability, border points with their core neighbour of the smallest id."""
    return f"""WITH RECURSIVE p AS MATERIALIZED ({points}),
 near AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM p a, p b WHERE list_distance(a.x, b.x) <= {eps}),
 core AS MATERIALIZED (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= {least}),
 e AS MATERIALIZED (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
 r AS (SELECT id, id AS root FROM core UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.root),
 l AS (SELECT id, min(root) AS label FROM r GROUP BY id),
 o AS (SELECT near.a AS id, min(near.b) AS core FROM near JOIN core ON core.id = near.b WHERE near.a NOT IN (SELECT id FROM core) GROUP BY near.a),
 f AS (SELECT id, label FROM l UNION ALL SELECT o.id, l.label FROM o JOIN l ON l.id = o.core),
 n AS (SELECT label, row_number() OVER (ORDER BY count(*) DESC, avg(p.x[1]), min(p.x)) - 1 AS number FROM f JOIN p ON p.id = f.id GROUP BY label)
 SELECT p.id AS {key}, coalesce(n.number, -1)::INT AS cluster FROM p LEFT JOIN f ON f.id = p.id LEFT JOIN n ON n.label = f.label"""


@query("dbscan", _dbscan_sql("SELECT vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings", "vec_id", 1.2, 5))
def dbscan(spark, sf_dir):
    return _labels(clustering.dbscan(_plain(spark, sf_dir), "vec_id", 1.2, 5))


# Balances in steps of 200 and the nation: dense and sparse cells, copies and border points.
@query("dbscan_customers", _dbscan_sql("SELECT c_custkey AS id, [round(c_acctbal / 200, 0), 2.0 * c_nationkey] AS x FROM customer", "c_custkey", 1.5, 5))
def dbscan_customers(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.array(F.round(F.col("c_acctbal") / 200), 2.0 * F.col("c_nationkey")).alias("x"))
    return clustering.relabelled(clustering.dbscan(features.from_array(rows, "x"), "c_custkey", 1.5, 5)).select("c_custkey", "cluster")


@query("agglomerative")
def agglomerative(spark, sf_dir):
    return _labels(clustering.agglomerative(_plain(spark, sf_dir), 4))


@query("meanshift")
def meanshift(spark, sf_dir):
    return _labels(clustering.mean_shift(features.reduced(_plain(spark, sf_dir), 2)))


@query("pca_2d")
def pca_2d(spark, sf_dir):
    return features.projection_2d(_plain(spark, sf_dir)).select("vec_id", F.round("pc_1", 6).alias("pc_1"), F.round("pc_2", 6).alias("pc_2"))


@query("tsne_2d")
def tsne_2d(spark, sf_dir):
    found = clustering.tsne(_plain(spark, sf_dir), "vec_id")
    return found.select("vec_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("clustering_job")
def clustering_job(spark, sf_dir):
    """The metrics of the whole job on a table with text and numbers."""
    found = jobs.cluster(table(spark, sf_dir, "customer"), ["c_acctbal", "c_nationkey"], ["c_mktsegment"], "kmeans", k=3)
    return spark.createDataFrame([(m, v) for m, v in found["metrics"].items()], "metric string, value double")


@query("dendrogram")
def dendrogram(spark, sf_dir):
    return clustering.dendrogram(_plain(spark, sf_dir))


@query("elbow")
def elbow(spark, sf_dir):
    return spark.createDataFrame([tuple(r.values()) for r in cluster_report.elbow(_plain(spark, sf_dir), 5)], "k int, inertia double, silhouette double, calinski_harabasz double, davies_bouldin double")


@query("information_criteria")
def information_criteria(spark, sf_dir):
    rows = features.reduced(_plain(spark, sf_dir), 2)
    return spark.createDataFrame([tuple(r.values()) for r in cluster_report.information_criteria(rows, 4)], "k int, bic double, aic double")


@query("prepared_features")
def prepared_features(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array

    found = features.prepare(table(spark, sf_dir, "customer"), ["c_acctbal", "c_nationkey"], ["c_mktsegment"], "standard", 0.9)
    return found.rows.select("c_custkey", F.transform(vector_to_array("features"), lambda x: F.round(x, 4)).alias("features"))
