"""Cleaning actions, comparisons and advice."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from sondage.operators import advice, cleaning
from sondage.plans.base import each, query, table
from sondage.plans.profiling import ALL, HOLES, NUMBERS, ORDER_COLUMNS, TWICE, _importance_sql, _k2_sql, _table_sql, holes, twice


@query("drop_duplicates", "SELECT DISTINCT * FROM orders")
def drop_duplicates(spark, sf_dir):
    return cleaning.drop_duplicates(twice(table(spark, sf_dir, "orders")))


@query("act_drop_columns", f"SELECT * EXCLUDE (l_tax) FROM {HOLES}")
def act_drop_columns(spark, sf_dir):
    """The column that is mostly missing goes."""
    df = holes(table(spark, sf_dir, "lineitem"))
    return cleaning.drop_critical_missing(df, cleaning.context(df))


@query("act_impute", f"SELECT l_orderkey, l_linenumber, coalesce(l_discount, (SELECT quantile_cont(l_discount, 0.5) FROM {HOLES})) AS l_discount, coalesce(flag, (SELECT flag FROM (SELECT CASE WHEN l_linenumber <> 2 THEN l_returnflag END AS flag FROM lineitem) WHERE flag IS NOT NULL GROUP BY flag ORDER BY count(*) DESC, flag LIMIT 1)) AS flag FROM (SELECT l_orderkey, l_linenumber, l_discount, CASE WHEN l_linenumber <> 2 THEN l_returnflag END AS flag FROM {HOLES})")
def act_impute(spark, sf_dir):
    df = holes(table(spark, sf_dir, "lineitem")).select("l_orderkey", "l_linenumber", "l_discount", F.when(F.col("l_linenumber") != 2, F.col("l_returnflag")).alias("flag"))
    return cleaning.fill_nulls(df, ["l_discount", "flag"])


@query("act_log1p", "SELECT o_orderkey, round(ln(1 + o_totalprice), 8) AS o_totalprice FROM orders")
def act_log1p(spark, sf_dir):
    return cleaning.log1p(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"]).select("o_orderkey", F.round("o_totalprice", 8).alias("o_totalprice"))


@query("act_log1p_shifted", "SELECT c_custkey, round(ln(1 + c_acctbal + (SELECT CASE WHEN min(c_acctbal) < 0 THEN abs(min(c_acctbal)) + 1 ELSE 0 END FROM customer)), 8) AS c_acctbal FROM customer")
def act_log1p_shifted(spark, sf_dir):
    return cleaning.log1p(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"]).select("c_custkey", F.round("c_acctbal", 8).alias("c_acctbal"))


@query("act_standardize", "SELECT o_orderkey, round((o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / (SELECT stddev_pop(o_totalprice) FROM orders), 6) AS o_totalprice FROM orders")
def act_standardize(spark, sf_dir):
    return cleaning.standardise(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"]).select("o_orderkey", F.round("o_totalprice", 6).alias("o_totalprice"))


@query("act_onehot", "SELECT o_orderkey, o_orderstatus = 'F' AS \"o_orderstatus_F\", o_orderstatus = 'O' AS \"o_orderstatus_O\", o_orderstatus = 'P' AS \"o_orderstatus_P\" FROM orders")
def act_onehot(spark, sf_dir):
    rows = cleaning.one_hot(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderstatus"])
    wanted = [f"o_orderstatus_{x}" for x in "FOP"]
    return rows.select("o_orderkey", *(F.col(c) if c in rows.columns else F.lit(False).alias(c) for c in wanted))


@query("act_yeo_johnson")
def act_yeo_johnson(spark, sf_dir):
    return cleaning.normalise_yeo(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), cleaning.Context(not_normal=["c_acctbal"])).select("c_custkey", F.round("c_acctbal", 4).alias("c_acctbal"))


@query("apply_actions")
def apply_actions(spark, sf_dir):
    rows, _ = cleaning.apply_actions(twice(table(spark, sf_dir, "orders")), ["drop_duplicates", "transform_skewed", "unknown", "standardize"])
    return rows


_FLAGS = f"""WITH m AS ({each(f'''SELECT '{{c}}' AS c, round(100 * count({{c}}) / count(*), 1) AS completeness FROM {HOLES}''', ALL)}),
 g AS ({each(f"SELECT '{{c}}' AS c, round(skewness({{c}}), 4) AS skewness FROM {HOLES}", NUMBERS)}), k AS ({_k2_sql(HOLES, NUMBERS)}), s AS ({_importance_sql(HOLES, NUMBERS, ["l_returnflag", "l_linestatus", "l_shipdate"])})
 SELECT m.c AS "column", m.completeness, s.score, g.skewness, k.p_value, m.completeness < 80 AS incomplete, m.completeness < 50 AS critical, m.completeness >= 50 AND m.completeness < 80 AS moderate, coalesce(abs(g.skewness) > 1, false) AS skewed, coalesce(s.score < 25, false) AS weak, coalesce(k.p_value < 0.05, false) AS not_normal
 FROM m LEFT JOIN g ON m.c = g.c LEFT JOIN k ON k."column" = m.c LEFT JOIN s ON s."column" = m.c"""


@query("recommendation_flags", _FLAGS)
def recommendation_flags(spark, sf_dir):
    return cleaning.flags(holes(table(spark, sf_dir, "lineitem")))


@query("recommendation_catalog", f"""WITH f AS ({_FLAGS}), c AS (SELECT count(*) FILTER (critical) AS critical, count(*) FILTER (moderate) AS moderate, count(*) FILTER (skewed) AS skewed, count(*) FILTER (weak) AS weak, count(*) FILTER (not_normal) AS not_normal FROM f), t AS ({_table_sql(HOLES, ALL, 8, 2)})
 SELECT 'drop_duplicates' AS action, n_duplicates > 0 AS applicable FROM t UNION ALL SELECT 'drop_critical_missing', critical > 0 FROM c UNION ALL SELECT 'impute_moderate_missing', moderate > 0 FROM c UNION ALL SELECT 'normalize_yeo', not_normal > 0 FROM c
 UNION ALL SELECT 'transform_skewed', skewed > 0 FROM c UNION ALL SELECT 'drop_low_importance', weak > 0 FROM c UNION ALL SELECT 'encode_categorical', true UNION ALL SELECT 'standardize', true""")
def recommendation_catalog(spark, sf_dir):
    return spark.createDataFrame(cleaning.catalog(cleaning.context(holes(table(spark, sf_dir, "lineitem")))), "action string, applicable boolean")


_PAIRS = " UNION ALL ".join(f"SELECT corr({a}, {b}) AS r FROM {HOLES}" for a, b in combinations(NUMBERS, 2))


@query("recommendation_indicators", f"""WITH t AS ({_table_sql(HOLES, ALL, 8, 2)}), f AS ({_FLAGS})
 SELECT (100 - any_value(completeness_all) > 20)::INT + (any_value(n_duplicates) > 0)::INT + (count(*) FILTER (skewed) > 0)::INT AS critical_problems, count(*) FILTER (incomplete) + count(*) FILTER (weak) AS columns_to_treat,
 (SELECT count(*) FILTER (NOT isnan(r) AND abs(r) >= 0.7) FROM ({_PAIRS})) AS redundant_pairs, count(*) FILTER (not_normal) AS not_normal_columns FROM f, (SELECT completeness AS completeness_all, n_duplicates FROM t)""")
def recommendation_indicators(spark, sf_dir):
    return cleaning.indicators(holes(table(spark, sf_dir, "lineitem")))


def _measures(source: str) -> str:
    names = ["n_rows", "n_columns", "n_missing", "completeness", "n_duplicates", "n_numeric", "n_text"]
    return " UNION ALL ".join(f"SELECT '{n}' AS measure, {n}::DOUBLE AS v FROM ({source})" for n in names)


@query("before_after_diff", f"SELECT b.measure, b.v AS before, a.v AS after, CASE WHEN a.v = b.v THEN '=' ELSE printf('%+.2f', a.v - b.v) END AS change FROM ({_measures(_table_sql(TWICE, ORDER_COLUMNS, 3, 2))}) b JOIN ({_measures(_table_sql('orders', ORDER_COLUMNS, 3, 2))}) a ON a.measure = b.measure")
def before_after_diff(spark, sf_dir):
    before = twice(table(spark, sf_dir, "orders"))
    return cleaning.before_after(before, cleaning.drop_duplicates(before))


@query("missing_before_after", f"SELECT c AS \"column\", before, after FROM ({each(f'''SELECT '{{c}}' AS c, (SELECT count(*) - count({{c}}) FROM {HOLES}) AS before, (SELECT count(*) - count({{c}}) FROM lineitem) AS after''', ALL)})")
def missing_before_after(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem")
    return cleaning.missing_before_after(holes(lineitem), lineitem)


@query("detected_steps")
def detected_steps(spark, sf_dir):
    before = twice(table(spark, sf_dir, "orders"))
    return spark.createDataFrame([(i, s) for i, s in enumerate(cleaning.detected_steps(before, cleaning.drop_duplicates(before).drop("o_custkey")))], "position int, step string")


_FITNESS = f"""WITH t AS ({_table_sql(HOLES, ALL, 8, 2)}), c AS (SELECT count(*) FILTER (k <= 1) AS n_constant, count(*) FILTER (k > 1 AND most / n > 0.95) AS n_nearly_constant FROM ({each(f"SELECT count(*) k, max(t) most, sum(t) n FROM (SELECT {{c}}, count(*) t FROM {HOLES} WHERE {{c}} IS NOT NULL GROUP BY {{c}})", NUMBERS)})),
 m AS (SELECT n_rows, round(100 * n_missing / n_cells, 2) AS missing_pct, n_duplicates, round(100 * n_duplicates / n_rows, 2) AS duplicate_pct, n_constant, n_nearly_constant, n_numeric, n_text FROM t, c),
 b AS (SELECT *, (n_rows < 10)::INT + (n_numeric = 0)::INT + (missing_pct > 50)::INT AS n_blockers, (n_rows >= 10 AND n_rows < 50)::INT + (n_numeric = 1)::INT + (missing_pct > 20 AND missing_pct <= 50)::INT + (duplicate_pct > 20)::INT + (n_constant > 0)::INT AS n_warnings, (missing_pct > 0 AND missing_pct <= 20)::INT + (duplicate_pct > 5 AND duplicate_pct <= 20)::INT + (n_nearly_constant > 0)::INT + (n_text > 0)::INT AS n_infos FROM m)
 SELECT *, greatest(0, least(100, 100 - 40 * n_blockers - 15 * n_warnings)) AS score, CASE WHEN n_blockers > 0 THEN 'bad' WHEN n_warnings > 0 THEN 'warn' ELSE 'ok' END AS status FROM b"""


@query("quality_score", _FITNESS)
def quality_score(spark, sf_dir):
    return advice.fitness(advice.fitness_measures(holes(table(spark, sf_dir, "lineitem"))))


@query("algorithm_ranking", f"""WITH f AS ({_FITNESS}), s AS (SELECT 0 AS i, 'kmeans' AS algorithm, least(95, 85 + CASE WHEN n_rows > 500 THEN 5 ELSE 0 END - CASE WHEN n_numeric > 30 THEN 10 ELSE 0 END) AS score FROM f
 UNION ALL SELECT 1, 'dbscan', least(90, 75 + CASE WHEN n_rows < 20000 THEN 5 ELSE -15 END - CASE WHEN missing_pct > 10 THEN 5 ELSE 0 END) FROM f UNION ALL SELECT 2, 'agglomerative', least(85, 70 + CASE WHEN n_rows <= 2000 THEN 10 ELSE -20 END) FROM f
 UNION ALL SELECT 3, 'gmm', least(85, 70 + CASE WHEN n_rows >= 100 THEN 5 ELSE -15 END - CASE WHEN n_numeric > n_rows THEN 20 ELSE 0 END) FROM f UNION ALL SELECT 4, 'meanshift', least(75, 60 - CASE WHEN n_rows > 3000 THEN 30 ELSE 0 END) FROM f)
 SELECT algorithm, score::INT AS score, row_number() OVER (ORDER BY score DESC, i)::INT AS rank FROM s""")
def algorithm_ranking(spark, sf_dir):
    return advice.algorithm_ranking(advice.fitness_measures(holes(table(spark, sf_dir, "lineitem"))))


_WORDS = "(" + ", ".join(f"'{w}'" for w in advice.ORDINAL_WORDS) + ")"
_DISTINCT = f"SELECT '{{c}}' AS c, count(DISTINCT {{c}}) AS d, count(DISTINCT lower({{c}})) FILTER (lower({{c}}) IN {_WORDS}) AS w FROM part"


@query("encoding_plan", f"""SELECT c AS "column", d AS n_distinct, CASE WHEN d = 2 THEN 'label' WHEN w >= 2 THEN 'ordinal' WHEN d <= 30 THEN 'one-hot' WHEN d <= 100 THEN 'frequency' ELSE 'drop or group' END AS encoding, CASE WHEN d = 2 OR w >= 2 OR d <= 10 THEN 'high' WHEN d <= 100 THEN 'medium' ELSE 'low' END AS priority
 FROM ({each(_DISTINCT, ["p_name", "p_brand", "p_type"])})""")
def encoding_plan(spark, sf_dir):
    return advice.encoding_plan(table(spark, sf_dir, "part"))
