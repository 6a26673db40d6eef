"""Questionnaire analyses, on answers made from the relational tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sondage.operators import questionnaire as Q
from sondage.plans.base import query, table

_ANSWERS = "(SELECT p_partkey, list_distinct(list_filter([trim(x) FOR x IN string_split(replace(p_name, ' ', '|'), '|')], lambda y: y <> '')) AS a FROM part)"


def answers(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.replace(F.col("p_name"), F.lit(" "), F.lit("|")).alias("answers"))


@query("multi_response_freq", f"SELECT answer, count(*) AS times FROM (SELECT unnest(a) AS answer FROM {_ANSWERS}) GROUP BY 1")
def multi_response_freq(spark, sf_dir):
    return Q.answer_counts(answers(spark, sf_dir), "answers")


_TOGETHER = f"SELECT x.v AS a, y.v AS b, count(*) AS times FROM (SELECT p_partkey, unnest(a) AS v FROM {_ANSWERS}) x JOIN (SELECT p_partkey, unnest(a) AS v FROM {_ANSWERS}) y ON x.p_partkey = y.p_partkey AND x.v < y.v GROUP BY 1, 2"


@query("cooccurrence", _TOGETHER)
def cooccurrence(spark, sf_dir):
    return Q.together(answers(spark, sf_dir), "answers")


@query("cooccurrence_top", f"{_TOGETHER} ORDER BY times DESC, a, b LIMIT 10")
def cooccurrence_top(spark, sf_dir):
    return Q.top_together(answers(spark, sf_dir), "answers")


@query("multi_response_one_hot", "SELECT o_orderkey, (o_orderstatus = 'F')::INT AS \"a|F\", (o_orderstatus = 'O')::INT AS \"a|O\", (o_orderstatus = 'P')::INT AS \"a|P\", 1 AS \"a|all\" FROM orders")
def multi_response_one_hot(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit(" all | "), F.col("o_orderstatus"), F.lit(" |")).alias("a"))
    return Q.one_hot_answers(df, "a").drop("a")


@query("json_range", """SELECT event_id, k::VARCHAR AS r_min, CASE WHEN event_id % 3 = 2 THEN NULL ELSE (k + 5)::VARCHAR END AS r_max, CASE WHEN event_id % 3 = 1 THEN '07:00' END AS r_mid, k::DOUBLE AS r_min_num, CASE WHEN event_id % 3 = 2 THEN NULL ELSE (k + 5)::DOUBLE END AS r_max_num, NULL::DOUBLE AS r_mid_num
 FROM (SELECT event_id, json_extract(props, '$.k')::INT AS k FROM events)""")
def json_range(spark, sf_dir):
    """The events' numbers as ranges in three spellings: strict, bare keys with a trailing comma, and no JSON at all."""
    k = F.get_json_object("props", "$.k").cast("int")
    text = F.when(F.col("event_id") % 3 == 0, F.format_string('{"min": %d, "max": %d}', k, k + 5)).when(F.col("event_id") % 3 == 1, F.format_string('{debut: %d, Fin: %d, mid: "07:00",}', k, k + 5)).otherwise(F.format_string("start: %d", k))
    return Q.json_range(table(spark, sf_dir, "events").select("event_id", text.alias("r")), "r", ["event_id"])


_CLEAN = r"trim(regexp_replace(regexp_replace(text, '[\x00-\x1f\x7f]', ' ', 'g'), '\s+', ' ', 'g'))"


@query("free_text_features", f"SELECT conv_id, turn, {_CLEAN} <> '' AS has_response, length({_CLEAN}) AS char_count, len(string_split({_CLEAN}, ' ')) AS word_count, md5({_CLEAN}) AS cleaned_md5 FROM conversations")
def free_text_features(spark, sf_dir):
    rows = Q.text_features(table(spark, sf_dir, "conversations"), "text", ["conv_id", "turn"])
    return rows.select("conv_id", "turn", "has_response", "char_count", "word_count", F.md5("cleaned").alias("cleaned_md5"))


def survey(spark, sf_dir):
    """Orders as answers: some missing, some refused."""
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    return orders.select(
        F.when(key % 4 != 0, F.col("o_totalprice")).alias("price"),
        F.when(key % 10 < 6, F.col("o_orderpriority")).when(key % 10 == 6, F.lit("N/A")).alias("priority"),
        F.when(key % 3 == 0, F.col("o_orderstatus")).alias("precisez"),
        F.when(key % 5 == 0, F.lit("rien")).otherwise(F.col("o_orderstatus")).alias("status"),
        F.col("o_custkey").alias("customer"),
    )


_SURVEY = "(SELECT CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END AS price, CASE WHEN o_orderkey % 10 < 6 THEN o_orderpriority WHEN o_orderkey % 10 = 6 THEN 'N/A' END AS priority, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS precisez, CASE WHEN o_orderkey % 5 = 0 THEN 'rien' ELSE o_orderstatus END AS status, o_custkey AS customer FROM orders)"
_RATE = f"SELECT {{i}} AS position, '{{c}}' AS \"column\", count(*) AS n_total, count(*) - count({{c}}) AS n_null, count(*) FILTER ({{r}}) AS n_refused, count({{c}}) - count(*) FILTER ({{r}}) AS n_response, {{f}} AS is_filter FROM {_SURVEY}"
_RATES = " UNION ALL ".join(_RATE.format(i=i, c=c, r=f"lower({c}) IN ('n/a', 'rien')" if c in ("priority", "precisez", "status") else "false", f="true" if c == "precisez" else "false") for i, c in enumerate(["price", "priority", "precisez", "status", "customer"]))
_RATES = f"SELECT *, round(100 * n_response / n_total, 1) AS rate, CASE WHEN round(100 * n_response / n_total, 1) >= 90 THEN 'high' WHEN round(100 * n_response / n_total, 1) >= 70 THEN 'medium' WHEN round(100 * n_response / n_total, 1) >= 50 THEN 'low' ELSE 'critical' END AS level FROM ({_RATES})"


@query("response_rates", _RATES)
def response_rates(spark, sf_dir):
    return Q.response_rates(survey(spark, sf_dir))


@query("uneven_sections", f"SELECT position // 5 AS section, count(*) AS n, min(rate) AS lowest, max(rate) AS highest FROM ({_RATES}) GROUP BY 1 HAVING count(*) = 5 AND max(rate) - min(rate) >= 30")
def uneven_sections(spark, sf_dir):
    return Q.uneven_sections(Q.response_rates(survey(spark, sf_dir)))


@query("consistency_issues", f"SELECT 'precisez' AS \"column\", 'priority' AS parent, count(*) AS n FROM {_SURVEY} WHERE precisez IS NOT NULL AND priority IS NULL")
def consistency_issues(spark, sf_dir):
    return Q.unparented(survey(spark, sf_dir))


@query("twin_columns", "SELECT 'a' AS a, 'b' AS b, round(corr(a, b), 4) AS r FROM (SELECT o_totalprice AS a, 2 * o_totalprice + o_orderkey % 7 AS b FROM orders)")
def twin_columns(spark, sf_dir):
    p = F.col("o_totalprice")
    return Q.twin_columns(table(spark, sf_dir, "orders").select(p.alias("a"), (2 * p + F.col("o_orderkey") % 7).alias("b"), (F.col("o_custkey") % 11).alias("c")))


_ORDINAL = "SELECT o_orderpriority AS value, count(*) AS times FROM orders GROUP BY 1"


@query("ordinal_stats", f"SELECT value, times, round(times / sum(times) OVER (), 6) AS share, (sum(times) OVER (ORDER BY value))::BIGINT AS cumulative, round(sum(times) OVER (ORDER BY value) / sum(times) OVER (), 6) AS cumulative_share FROM ({_ORDINAL})")
def ordinal_stats(spark, sf_dir):
    rows = Q.ordinal_stats(table(spark, sf_dir, "orders"), "o_orderpriority")
    return rows.select("value", "times", F.round("share", 6).alias("share"), "cumulative", F.round("cumulative_share", 6).alias("cumulative_share"))


@query("ordinal_summary", f"""WITH c AS ({_ORDINAL}), s AS (SELECT value, times, times / sum(times) OVER () AS p, sum(times) OVER (ORDER BY value) / sum(times) OVER () AS cum, row_number() OVER (ORDER BY value) AS i, count(*) OVER () AS k FROM c)
 SELECT sum(times)::BIGINT AS n, count(*) AS n_values, round(-sum(p * log2(p + 1e-12)) / log2(count(*)), 4) AS entropy, min(value) FILTER (cum >= 0.5) AS median, (SELECT value FROM c ORDER BY times DESC, value LIMIT 1) AS mode, round(100 * sum(p) FILTER (i IN (k // 2, k // 2 + 1)), 1) AS centrality FROM s""")
def ordinal_summary(spark, sf_dir):
    return Q.ordinal_summary(table(spark, sf_dir, "orders"), "o_orderpriority")


@query("field_types")
def field_types(spark, sf_dir):
    rows = [(name, c, t) for name, df in (("survey", survey(spark, sf_dir)), ("parts", answers(spark, sf_dir)), ("conversations", table(spark, sf_dir, "conversations"))) for c, t in Q.field_types(df).items()]
    return spark.createDataFrame(rows, "table_name string, column string, field_type string")
