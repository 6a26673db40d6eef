"""Personal data in the relational and text tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sondage.functions import personal as P
from sondage.operators import personal
from sondage.plans.base import query, table

SALT = "sondage"
_ORDER_TYPES = {"o_orderkey": "numeric_id", "o_custkey": "none", "o_orderstatus": "none", "o_totalprice": "phone", "o_orderdate": "date_precise", "o_orderpriority": "none"}
_PSEUDO = "'ID_' || upper(substr(sha256('" + SALT + "::' || {c}::VARCHAR), 1, 10))"


@query("pii_pseudonymize", f"SELECT c_custkey, {_PSEUDO.format(c='c_name')} AS c_name FROM customer")
def pii_pseudonymize(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", P.pseudonym(F.col("c_name"), SALT).alias("c_name"))


@query("pii_key_table", f"SELECT DISTINCT p_brand AS value, {_PSEUDO.format(c='p_brand')} AS pseudonym FROM part")
def pii_key_table(spark, sf_dir):
    return personal.key_table(table(spark, sf_dir, "part"), "p_brand", SALT)


@query("pii_mask", "SELECT conv_id, turn, CASE WHEN text IS NOT NULL THEN '[MASKED]' END AS text FROM conversations")
def pii_mask(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", P.mask(F.col("text")).alias("text"))


_SCRUB = r"regexp_replace(regexp_replace(regexp_replace(text, '[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+', '[EMAIL]', 'g'), '\+?\d[\d\s\-\.\(\)]{7,}\d', '[PHONE]', 'g'), '\b\d{5}\b', '[CP]', 'g')"


@query("pii_scrub_text", f"SELECT doc_id, md5({_SCRUB}) AS text_md5 FROM documents")
def pii_scrub_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(P.scrub(F.col("text"), names=False)).alias("text_md5"))


@query("pii_scrub_names")
def pii_scrub_names(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", P.scrub(F.col("text")).alias("text"))


@query("pii_generalize_date", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month FROM orders")
def pii_generalize_date(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", P.month_of(F.col("o_orderdate")).alias("month"))


@query("pii_generalize_text_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN strftime(o_orderdate, '%Y-%m') ELSE '[DATE_MASKED]' END AS month FROM orders")
def pii_generalize_text_date(spark, sf_dir):
    """Dates as text in four known formats and an unknown one."""
    d = F.col("o_orderdate")
    forms = ["yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy", "yyyy/MM/dd", "dd-MM-yyyy"]
    text = F.lit("on no day")
    for i, form in enumerate(forms):
        text = F.when(F.col("o_orderkey") % 5 == i, F.date_format(d, form)).otherwise(text)
    return table(spark, sf_dir, "orders").select("o_orderkey", P.generalise_date(text).alias("month"))


@query("pii_round", "SELECT event_id, round(value, 2) AS value FROM events")
def pii_round(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round("value", 2).alias("value"))


@query("pii_address", r"SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '[ADDR_MASKED]' ELSE 'CP ' || lpad((c_custkey % 90000 + 10000)::VARCHAR, 5, '0') || ' ' || c_mktsegment || ' ' || 'Nord' END AS address FROM customer")
def pii_address(spark, sf_dir):
    code = F.lpad((F.col("c_custkey") % 90000 + 10000).cast("string"), 5, "0")
    text = F.when(F.col("c_custkey") % 3 == 0, F.lit("12 rue Haute")).otherwise(F.concat(F.lit("12 rue Haute, "), code, F.lit("  "), F.col("c_mktsegment"), F.lit(" Nord Europe")))
    return table(spark, sf_dir, "customer").select("c_custkey", P.generalise_address(text).alias("address"))


@query("pii_anonymise_orders", f"SELECT {_PSEUDO.format(c='o_orderkey')} AS o_orderkey, o_custkey, o_orderstatus, '[MASKED]' AS o_totalprice, strftime(o_orderdate, '%Y-%m') AS o_orderdate, o_orderpriority FROM orders")
def pii_anonymise_orders(spark, sf_dir):
    return personal.anonymise(table(spark, sf_dir, "orders"), _ORDER_TYPES, SALT)


@query("pii_log", "SELECT c.\"column\", c.kind, count(*) AS n_values, CASE WHEN c.kind = 'none' THEN 0 ELSE count(*) END AS n_treated FROM orders, (VALUES ('o_orderkey', 'numeric_id'), ('o_custkey', 'none'), ('o_orderstatus', 'none'), ('o_totalprice', 'phone'), ('o_orderdate', 'date_precise'), ('o_orderpriority', 'none')) c(\"column\", kind) GROUP BY 1, 2")
def pii_log(spark, sf_dir):
    return personal.treatment_log(table(spark, sf_dir, "orders"), _ORDER_TYPES, SALT)


@query("pii_log_totals", "SELECT 6::BIGINT AS n_columns, 3::BIGINT AS n_personal, 3 * count(*) AS n_treated FROM orders")
def pii_log_totals(spark, sf_dir):
    return personal.log_totals(personal.treatment_log(table(spark, sf_dir, "orders"), _ORDER_TYPES, SALT))


@query("pii_types")
def pii_types(spark, sf_dir):
    rows = [(name, c, kind) for name in ("customer", "orders", "events") for c, kind in personal.detect_types(table(spark, sf_dir, name)).items()]
    return spark.createDataFrame(rows, "table_name string, column string, kind string")


@query("rename_columns", "SELECT n_nationkey AS VAR_01, n_name AS VAR_02, n_regionkey AS VAR_03 FROM nation")
def rename_columns(spark, sf_dir):
    return personal.renamed(table(spark, sf_dir, "nation"))[0]
