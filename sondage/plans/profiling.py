"""Profiles, distributions, correlation, importance and normality of the relational tables."""

from __future__ import annotations

import functools
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage.functions import stats
from sondage.operators import correlation, importance, normality, profile
from sondage.plans.base import each, query, table

NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
OTHERS = ["l_returnflag", "l_linestatus", "l_shipdate"]
ALL = [*NUMBERS, *OTHERS]
ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
#: lineitem with missing cells.
HOLES = "(SELECT * REPLACE (CASE WHEN l_linenumber = 4 THEN NULL ELSE l_discount END AS l_discount, CASE WHEN l_linenumber <> 1 THEN NULL ELSE l_tax END AS l_tax) FROM lineitem)"
#: orders with some rows twice.
TWICE = "(SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey % 10 = 0)"


def holes(lineitem: DataFrame) -> DataFrame:
    return lineitem.withColumns({"l_discount": F.when(F.col("l_linenumber") != 4, F.col("l_discount")), "l_tax": F.when(F.col("l_linenumber") == 1, F.col("l_tax"))})


def twice(orders: DataFrame) -> DataFrame:
    return orders.union(orders.where("o_orderkey % 10 = 0"))


_NUMERIC_ROW = """SELECT '{c}' AS "column", count({c}) AS n, count(*) - count({c}) AS n_missing, round(min({c})::DOUBLE, 4) AS min, round(max({c})::DOUBLE, 4) AS max, round(avg({c}), 4) AS mean,
 round(quantile_cont({c}::DOUBLE, 0.5), 4) AS median, round(stddev_samp({c}), 4) AS std, round(skewness({c}), 4) AS skewness, round(kurtosis({c}), 4) AS kurtosis FROM """


@query("column_profile_numeric", each(_NUMERIC_ROW + HOLES, NUMBERS))
def column_profile_numeric(spark, sf_dir):
    return profile.numeric_profile(holes(table(spark, sf_dir, "lineitem")), NUMBERS)


@query("numeric_profile_events", _NUMERIC_ROW.replace("{c}", "value") + "events")
def numeric_profile_events(spark, sf_dir):
    return profile.numeric_profile(table(spark, sf_dir, "events"), ["value"])


_CATEGORY_ROW = """SELECT '{c}' AS "column", count({c}) AS n, count(*) - count({c}) AS n_missing, round(100 * count({c}) / count(*), 1) AS completeness, count(DISTINCT {c}) AS n_distinct,
 (SELECT {c}::VARCHAR FROM FROM_ GROUP BY {c} HAVING {c} IS NOT NULL ORDER BY count(*) DESC, {c} LIMIT 1) AS mode FROM FROM_"""


@query("column_profile_categorical", each(_CATEGORY_ROW.replace("FROM_", "orders"), ["o_orderstatus", "o_orderpriority", "o_custkey"]))
def column_profile_categorical(spark, sf_dir):
    return profile.column_profile(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority", "o_custkey"])


@query("column_profile_lineitem", each(_CATEGORY_ROW.replace("FROM_", HOLES), ["l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"]))
def column_profile_lineitem(spark, sf_dir):
    return profile.column_profile(holes(table(spark, sf_dir, "lineitem")), ["l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"])


@query("value_frequencies", each("""SELECT '{c}' AS "column", {c}::VARCHAR AS value, count(*) AS times FROM lineitem WHERE {c} IS NOT NULL GROUP BY {c}""", ["l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey"]))
def value_frequencies(spark, sf_dir):
    return profile.frequencies(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey"]).drop("number")


_TABLE = """SELECT count(*) AS n_rows, {k} AS n_columns, count(*) * {k} AS n_cells, sum(missing)::BIGINT AS n_missing, round(100 * (1 - sum(missing) / (count(*) * {k})), 2) AS completeness,
 count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM FROM_)) AS n_duplicates, {num} AS n_numeric, {text} AS n_text FROM (SELECT MISSING_ AS missing FROM FROM_)"""


def _table_sql(source: str, columns: list[str], numeric: int, text: int) -> str:
    missing = " + ".join(f"({c} IS NULL)::INT" for c in columns)
    return _TABLE.format(k=len(columns), num=numeric, text=text).replace("FROM_", source).replace("MISSING_", missing)


@query("table_profile", _table_sql(HOLES, ALL, 8, 2))
def table_profile(spark, sf_dir):
    return profile.table_profile(holes(table(spark, sf_dir, "lineitem")))


@query("duplicate_count", _table_sql(TWICE, ORDER_COLUMNS, 3, 2))
def duplicate_count(spark, sf_dir):
    return profile.table_profile(twice(table(spark, sf_dir, "orders")))


@query("missing_report", each(f"""SELECT '{{c}}' AS "column", count(*) - count({{c}}) AS n_missing, round(100 * count({{c}}) / count(*), 1) AS completeness, CASE WHEN round(100 * count({{c}}) / count(*), 1) >= 80 THEN 'ok' WHEN round(100 * count({{c}}) / count(*), 1) >= 50 THEN 'attention' ELSE 'critical' END AS status FROM {HOLES}""", ALL))
def missing_report(spark, sf_dir):
    return profile.missing_report(holes(table(spark, sf_dir, "lineitem")))


@query("top_values", "SELECT p_type AS value, count(*) AS times FROM part GROUP BY 1 ORDER BY times DESC, value LIMIT 20")
def top_values(spark, sf_dir):
    return profile.top_values(table(spark, sf_dir, "part"), "p_type")


@query("top_event_types", "SELECT event_type AS value, count(*) AS times FROM events GROUP BY 1 ORDER BY times DESC, value LIMIT 20")
def top_event_types(spark, sf_dir):
    return profile.top_values(table(spark, sf_dir, "events"), "event_type")


_HISTOGRAM = """WITH s AS (SELECT min({c}) lo, (max({c}) - min({c})) / 20 w, count(*) n FROM FROM_), b AS (SELECT least(floor(({c} - lo) / w), 19)::INT bin, count(*) times FROM FROM_, s GROUP BY 1)
SELECT i::INT AS bin, round(lo + i * w, 4) AS lo, round(lo + (i + 1) * w, 4) AS hi, coalesce(times, 0) AS times, round(coalesce(times, 0) / (n * w), 8) AS density FROM s, range(20) t(i) LEFT JOIN b ON b.bin = t.i"""


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.select("bin", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"), "times", F.round("density", 8).alias("density"))


@query("histogram_extendedprice", _HISTOGRAM.replace("{c}", "l_extendedprice").replace("FROM_", "lineitem"))
def histogram_extendedprice(spark, sf_dir):
    return _rounded(profile.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice"))


@query("density_histogram_events", _HISTOGRAM.replace("{c}", "value").replace("FROM_", "events"))
def density_histogram_events(spark, sf_dir):
    return _rounded(profile.histogram(table(spark, sf_dir, "events"), "value"))


_FENCES = "(SELECT quantile_cont({c}, 0.25) q1, quantile_cont({c}, 0.5) med, quantile_cont({c}, 0.75) q3, min({c}) lo, max({c}) hi, avg({c}) mean FROM FROM_)"
_BOX = f"SELECT round(lo, 4) AS min, round(q1, 4) AS q1, round(med, 4) AS median, round(q3, 4) AS q3, round(hi, 4) AS max, round(mean, 4) AS mean, (SELECT count(*) FROM FROM_ WHERE {{c}} < q1 - 1.5 * (q3 - q1) OR {{c}} > q3 + 1.5 * (q3 - q1)) AS n_outliers FROM {_FENCES}"


def _box(spark, sf_dir, name: str, column: str) -> DataFrame:
    rows = profile.box_plot(table(spark, sf_dir, name), column)
    return rows.select(*(F.round(c, 4).alias(c) for c in rows.columns if c != "n_outliers"), "n_outliers")


@query("boxplot_acctbal", _BOX.replace("{c}", "c_acctbal").replace("FROM_", "customer"))
def boxplot_acctbal(spark, sf_dir):
    return _box(spark, sf_dir, "customer", "c_acctbal")


@query("boxplot_events", _BOX.replace("{c}", "value").replace("FROM_", "events"))
def boxplot_events(spark, sf_dir):
    return _box(spark, sf_dir, "events", "value")


@query("outliers_events", f"SELECT event_id, value FROM events, {_FENCES} WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)".replace("{c}", "value").replace("FROM_", "events"))
def outliers_events(spark, sf_dir):
    return profile.outliers(table(spark, sf_dir, "events").select("event_id", "value"), "value")


@query("distribution_alerts", f"""SELECT "column", concat_ws(', ', CASE WHEN n = 0 THEN 'empty' END, CASE WHEN abs(skewness) > 1 THEN 'asymmetric' END, CASE WHEN kurtosis > 3 THEN 'heavy tails' END) AS alerts FROM ({each(_NUMERIC_ROW + HOLES, NUMBERS)})""")
def distribution_alerts(spark, sf_dir):
    return profile.distribution_alerts(profile.numeric_profile(holes(table(spark, sf_dir, "lineitem")), NUMBERS))


def _pairs_sql(source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, CASE WHEN stddev_pop(CASE WHEN {b} IS NOT NULL THEN {a} END) > 0 AND stddev_pop(CASE WHEN {a} IS NOT NULL THEN {b} END) > 0 THEN corr({a}, {b}) END AS r FROM {source}" for a, b in combinations(columns, 2))


@query("correlation_pairs", f"SELECT a, b, round(r, 6) AS r FROM ({_pairs_sql(HOLES, NUMBERS)})")
def correlation_pairs(spark, sf_dir):
    return correlation.correlations(holes(table(spark, sf_dir, "lineitem")), NUMBERS).select("a", "b", F.round("r", 6).alias("r"))


@query("correlation_matrix", f"WITH p AS ({_pairs_sql('lineitem', NUMBERS)}) SELECT a, b, round(r, 6) AS r FROM (SELECT * FROM p UNION ALL SELECT b, a, r FROM p UNION ALL SELECT c, c, 1.0 FROM (SELECT a c FROM p UNION SELECT b FROM p))")
def correlation_matrix(spark, sf_dir):
    return correlation.matrix(correlation.correlations(table(spark, sf_dir, "lineitem"), NUMBERS)).select("a", "b", F.round("r", 6).alias("r"))


@query("strong_pairs", f"SELECT a, b, round(abs(r), 4) AS strength FROM ({_pairs_sql('lineitem', NUMBERS)}) WHERE round(abs(r), 4) >= 0.7")
def strong_pairs(spark, sf_dir):
    return correlation.ranked_pairs(correlation.correlations(table(spark, sf_dir, "lineitem"), NUMBERS), correlation.STRONG).drop("r")


def _importance_sql(source: str, numeric: list[str], others: list[str]) -> str:
    pairs = _pairs_sql(source, numeric)
    number = f"SELECT '{{c}}' AS c, count({{c}}) / count(*) AS completeness, coalesce(least(1, greatest(0, stddev_samp({{c}}) / (abs(avg({{c}})) + 1e-9))), 0) AS variability, count(DISTINCT {{c}}) / count(*) AS uniqueness FROM {source}"
    other = f"SELECT '{{c}}' AS c, sum(t) / (SELECT count(*) FROM {source}) AS completeness, CASE WHEN count(*) > 1 THEN -sum(t / n * log2(t / n + 1e-9)) / log2(count(*)) ELSE 0 END AS variability, count(*) / (SELECT count(*) FROM {source}) AS uniqueness FROM (SELECT t, sum(t) OVER () AS n FROM (SELECT {{c}}, count(*) t FROM {source} WHERE {{c}} IS NOT NULL GROUP BY {{c}}))"
    return f"""WITH p AS ({pairs}), m AS (SELECT c, max(abs(r)) AS corr_max FROM (SELECT a c, r FROM p UNION ALL SELECT b, r FROM p) GROUP BY c),
 x AS ({each(number, numeric)} UNION ALL {each(other, others)}),
 y AS (SELECT x.c, completeness, variability, coalesce(corr_max, 0) AS corr_max, uniqueness FROM x LEFT JOIN m ON x.c = m.c),
 z AS (SELECT c AS "column", round(100 * completeness, 1) AS completeness, round(100 * variability, 1) AS variability, round(100 * corr_max, 1) AS corr_max, round(100 * uniqueness, 1) AS uniqueness, round(100 * (0.30 * completeness + 0.35 * variability + 0.20 * corr_max + 0.15 * uniqueness), 1) AS score FROM y)
 SELECT *, row_number() OVER (ORDER BY score DESC, "column")::INT AS rank FROM z"""


_LINEITEM = _importance_sql("lineitem", NUMBERS, OTHERS)
_CUSTOMER = _importance_sql("customer", ["c_custkey", "c_nationkey", "c_acctbal"], ["c_name", "c_mktsegment"])


@query("importance_lineitem", _LINEITEM)
def importance_lineitem(spark, sf_dir):
    return importance.importance(table(spark, sf_dir, "lineitem"))


@query("importance_customer", _CUSTOMER)
def importance_customer(spark, sf_dir):
    return importance.importance(table(spark, sf_dir, "customer"))


@query("importance_topn", f"SELECT * FROM ({_LINEITEM}) WHERE rank <= 5")
def importance_topn(spark, sf_dir):
    return importance.top_importance(importance.importance(table(spark, sf_dir, "lineitem")), 5)


@query("score_decomposition", f"""WITH s AS ({_CUSTOMER}) SELECT "column", 'completeness' AS component, completeness AS value, 0.30::DOUBLE AS weight, round(completeness * 0.30, 2) AS points FROM s UNION ALL SELECT "column", 'variability', variability, 0.35, round(variability * 0.35, 2) FROM s UNION ALL SELECT "column", 'corr_max', corr_max, 0.20, round(corr_max * 0.20, 2) FROM s UNION ALL SELECT "column", 'uniqueness', uniqueness, 0.15, round(uniqueness * 0.15, 2) FROM s""")
def score_decomposition(spark, sf_dir):
    return importance.decomposition(importance.importance(table(spark, sf_dir, "customer")))


@query("variables", f"""SELECT p."column", p.completeness, p.n_distinct, s.score, s.rank FROM ({each(_CATEGORY_ROW.replace("FROM_", "customer"), ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"])}) p LEFT JOIN ({_CUSTOMER}) s ON p."column" = s."column" """)
def variables(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    return importance.variables(profile.column_profile(customer), importance.importance(customer)).select("column", "completeness", "n_distinct", "score", "rank")


def _k2_sql(source: str, columns: list[str]) -> str:
    base = each(f"SELECT '{{c}}' AS c, count({{c}})::DOUBLE AS n, avg(power({{c}} - m, 3)) / power(avg(power({{c}} - m, 2)), 1.5) AS g1, avg(power({{c}} - m, 4)) / power(avg(power({{c}} - m, 2)), 2) AS b2 FROM (SELECT {{c}}::DOUBLE AS {{c}}, avg({{c}}::DOUBLE) OVER () AS m FROM {source} WHERE {{c}} IS NOT NULL)", columns)
    return f"""WITH a AS ({base}),
 b AS (SELECT *, g1 * sqrt((n+1)*(n+3)/(6*(n-2))) AS y, 3*(n*n+27*n-70)*(n+1)*(n+3)/((n-2)*(n+5)*(n+7)*(n+9)) AS beta, 3*(n-1)/(n+1) AS e, 24*n*(n-2)*(n-3)/((n+1)*(n+1)*(n+3)*(n+5)) AS v, 6*(n*n-5*n+2)/((n+7)*(n+9))*sqrt(6*(n+3)*(n+5)/(n*(n-2)*(n-3))) AS s FROM a),
 d AS (SELECT *, -1 + sqrt(2*(beta-1)) AS w2, (b2-e)/sqrt(v) AS x, 6+8/s*(2/s+sqrt(1+4/(s*s))) AS aa FROM b),
 f AS (SELECT *, 1/sqrt(0.5*ln(w2)) AS delta, sqrt(2/(w2-1)) AS alpha, 1+x*sqrt(2/(aa-4)) AS dd FROM d),
 z AS (SELECT c, n, delta*ln(y/alpha+sqrt(power(y/alpha,2)+1)) AS z1, (1-2/(9*aa)-sign(dd)*cbrt((1-2/aa)/abs(dd)))/sqrt(2/(9*aa)) AS z2 FROM f)
 SELECT c AS "column", n::BIGINT AS n, round(z1*z1+z2*z2, 4) AS k2, round(exp(-(z1*z1+z2*z2)/2), 6) AS p_value, exp(-(z1*z1+z2*z2)/2) >= 0.05 AS normal FROM z"""


_K2_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount"]


@query("normality_k2", _k2_sql(HOLES, _K2_COLUMNS))
def normality_k2(spark, sf_dir):
    return normality.dagostino(holes(table(spark, sf_dir, "lineitem")), _K2_COLUMNS)


# No column of ``lineitem`` is normal by the consensus of the tests, so each has a suggestion.
@query("transform_suggestion", f"""WITH s AS ({each("SELECT '{c}' AS c, skewness({c}) AS g, kurtosis({c}) AS k, min({c}) AS lo FROM lineitem", _K2_COLUMNS)})
SELECT c AS "column", CASE WHEN g > 1 AND lo >= 0 THEN 'log1p' WHEN g > 0.5 THEN 'sqrt' WHEN g < -1 THEN 'square' WHEN abs(s.k) > 3 THEN 'yeo-johnson or box-cox' ELSE 'yeo-johnson' END AS suggestion FROM s""")
def transform_suggestion(spark, sf_dir):
    return normality.suggestions(table(spark, sf_dir, "lineitem"), _K2_COLUMNS)


def _tail_sql(z: str) -> str:
    """ln of the normal distribution function of ``z``, a column: by the error function, far below by the series of the tail."""
    t = f"(1 / (1 + 0.3275911 * abs({z} / sqrt(2))))"
    erf = f"sign({z}) * (1 - {t} * (0.254829592 + {t} * (-0.284496736 + {t} * (1.421413741 + {t} * (-1.453152027 + {t} * 1.061405429)))) * exp(-{z} * {z} / 2))"
    return f"CASE WHEN {z} < -5 THEN -{z} * {z} / 2 - ln(-{z} * sqrt(2 * pi())) + ln(1 - 1 / power({z}, 2) + 3 / power({z}, 4) - 15 / power({z}, 6) + 105 / power({z}, 8)) ELSE ln(0.5 * (1 + {erf})) END"


_ANDERSON = f"""WITH r AS (SELECT {{c}}::DOUBLE AS x, row_number() OVER (ORDER BY {{c}}) AS i, count(*) OVER () AS n, avg({{c}}) OVER () AS m, stddev_samp({{c}}) OVER () AS s FROM FROM_ WHERE {{c}} IS NOT NULL),
 z AS (SELECT *, (x - m) / s AS z, -(x - m) / s AS y FROM r), a AS (SELECT any_value(n) AS n, -any_value(n) - sum(((2 * i - 1) * {_tail_sql('z')} + (2 * (n + 1 - i) - 1) * {_tail_sql('y')}) / n) AS a FROM z)
 SELECT '{{c}}' AS "column", n, round(a, 4) AS statistic, round(0.787 / (1 + 4 / n - 25 / (n * n)), 3) AS critical, a < round(0.787 / (1 + 4 / n - 25 / (n * n)), 3) AS normal FROM a"""


def _quantile_sql(p: str) -> str:
    """The inverse normal distribution function of ``p``, a column, by the same rational approximation."""
    poly = lambda x, terms: functools.reduce(lambda out, t: f"({out} * {x} + {t!r})", terms[1:], repr(terms[0]))
    low, high, q = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))", f"({p} - 0.5)"
    tail = lambda x: f"{poly(x, stats.TAIL)} / ({poly(x, stats.TAIL_UNDER)} * {x} + 1)"
    return f"CASE WHEN {p} < 0.02425 THEN {tail(low)} WHEN {p} > 1 - 0.02425 THEN -({tail(high)}) ELSE {poly(f'({q} * {q})', stats.MIDDLE)} * {q} / ({poly(f'({q} * {q})', stats.MIDDLE_UNDER)} * {q} * {q} + 1) END"


_POINTS = f"""WITH r AS (SELECT c_acctbal AS x, row_number() OVER (ORDER BY c_acctbal) AS i, count(*) OVER () AS n FROM customer),
 m AS (SELECT *, CASE WHEN i = n THEN power(0.5, 1 / n) WHEN i = 1 THEN 1 - power(0.5, 1 / n) ELSE (i - 0.3175) / (n + 0.365) END AS p FROM r), q AS (SELECT i, {_quantile_sql('p')} AS theoretical, x AS observed FROM m)"""


@query("normality_anderson", _ANDERSON.replace("{c}", "c_acctbal").replace("FROM_", "customer"))
def normality_anderson(spark, sf_dir):
    return normality.anderson_darling(table(spark, sf_dir, "customer"), "c_acctbal")


@query("normality_shapiro")
def normality_shapiro(spark, sf_dir):
    return normality.shapiro_wilk(table(spark, sf_dir, "customer"), ["c_acctbal"])


@query("normality_verdicts")
def normality_verdicts(spark, sf_dir):
    return normality.verdicts(table(spark, sf_dir, "orders"), ["o_totalprice"])


@query("normality_summary")
def normality_summary(spark, sf_dir):
    return normality.summary(normality.verdicts(table(spark, sf_dir, "customer"), ["c_acctbal", "c_nationkey"]))


# Ties, nulls and values far from the others.
_ODD = "(SELECT CASE WHEN l_linenumber = 7 THEN NULL WHEN l_orderkey % 97 = 0 THEN 1e12 ELSE l_quantity END AS x FROM lineitem)"


@query("anderson_ties", _ANDERSON.replace("{c}", "x").replace("FROM_", _ODD))
def anderson_ties(spark, sf_dir):
    x = F.when(F.col("l_linenumber") == 7, None).when(F.col("l_orderkey") % 97 == 0, 1e12).otherwise(F.col("l_quantity"))
    return normality.anderson_darling(table(spark, sf_dir, "lineitem").select(x.alias("x")), "x")


@query("qq_points", _POINTS + " SELECT i, round(theoretical, 6) AS theoretical, observed FROM q")
def qq_points(spark, sf_dir):
    return normality.qq_points(table(spark, sf_dir, "customer"), "c_acctbal").select("i", F.round("theoretical", 6).alias("theoretical"), "observed")


@query("qq_line", _POINTS + " SELECT round(regr_slope(observed, theoretical), 4) AS slope, round(regr_intercept(observed, theoretical), 4) AS intercept, round(corr(observed, theoretical), 6) AS r FROM q")
def qq_line(spark, sf_dir):
    line = normality.qq_line(normality.qq_points(table(spark, sf_dir, "customer"), "c_acctbal"))
    return line.select(F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r", 6).alias("r"))


@query("normal_curve", "WITH s AS (SELECT min(c_acctbal) lo, max(c_acctbal) hi, avg(c_acctbal) m, stddev_samp(c_acctbal) sd FROM customer) SELECT i::INT AS k, round(lo + (hi - lo) * i / 199, 4) AS x, round(exp(-0.5 * power((lo + (hi - lo) * i / 199 - m) / sd, 2)) / (sd * sqrt(2 * pi())), 10) AS density FROM s, range(200) t(i)")
def normal_curve(spark, sf_dir):
    return normality.normal_curve(table(spark, sf_dir, "customer"), "c_acctbal").select("k", F.round("x", 4).alias("x"), F.round("density", 10).alias("density"))


@query("value_ranks", "SELECT c_acctbal AS x, count(*) OVER () AS n, row_number() OVER (ORDER BY c_acctbal) AS i FROM customer")
def value_ranks(spark, sf_dir):
    return profile.numbered(table(spark, sf_dir, "customer"), "c_acctbal")
