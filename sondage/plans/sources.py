"""Tables as delimited text, scanned again: quoted line feeds and delimiters, missing cells, records with too many fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage.plans.base import query, table
from sondage.sources import delimited
from sondage.sources.staging import Staging


def _scanned(rows: DataFrame, delimiter: str = ";") -> delimited.Scan:
    """The rows written as text with a header in each file, and scanned."""
    path = f"{Staging(rows.sparkSession, 'scan').root}/table.csv"
    rows.write.option("header", True).option("sep", delimiter).option("escape", '"').option("emptyValue", "").csv(path)
    return delimited.scan(rows.sparkSession, path)


@query("scan_rows", """SELECT c_custkey AS id, CASE WHEN c_custkey % 7 <> 0 THEN c_name || chr(10) || '"' || c_mktsegment || '";' || c_nationkey END AS note, c_nationkey::BIGINT AS nation FROM customer""")
def scan_rows(spark, sf_dir):
    note = F.when(F.col("c_custkey") % 7 != 0, F.concat("c_name", F.lit('\n"'), "c_mktsegment", F.lit('";'), F.col("c_nationkey").cast("string")))
    return _scanned(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), note.alias("note"), F.col("c_nationkey").alias("nation"))).rows


@query("scan_rejected", "SELECT c_custkey || ';' || c_name || ';' || c_mktsegment || ';' || c_nationkey AS raw, 4 AS n_fields, 3 AS n_expected FROM customer WHERE c_custkey % 10 = 0")
def scan_rejected(spark, sf_dir):
    # Written as one column with another delimiter, so that no cell is quoted: one with a delimiter makes its record too long.
    note = F.when(F.col("c_custkey") % 10 == 0, F.concat_ws(";", "c_name", "c_mktsegment")).otherwise(F.col("c_name"))
    rows = table(spark, sf_dir, "customer").select(F.concat_ws(";", F.col("c_custkey").cast("string"), note, F.col("c_nationkey").cast("string")).alias("id;note;nation"))
    return _scanned(rows, "\x01").rejected.drop("line")
