"""Detection and anonymisation of personal data, column by column."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sondage.functions import personal as P
from sondage.operators.profile import frequencies
from sondage.operators.types import clean, is_number, scalar_columns

# Column-name patterns, tried in this order.
NAME_PATTERNS = {
    "email": r"email|mail|courriel|e-mail",
    "phone": r"tel|phone|mobile|portable|fax|gsm|sms",
    "address": r"adresse|address|rue|street|avenue|boulevard|domicile|travail|lieu",
    "gps_lat": r"lat|latitude",
    "gps_lon": r"lon|long|longitude",
    "name": r"nom|prenom|name|firstname|lastname|surname|appelant|personne",
    "date_precise": r"date|heure|horaire|timestamp|time|datetime|created|updated",
    "free_text": r"commentaire|comment|note|texte|text|description|observation|remarque",
    "postcode": r"postal|postcode|zip|code.?postal|cp",
    "city": r"ville|city|commune|municipality|localite",
    "id_direct": r"^(id|identifiant|identifier|uuid|ref|numero|num)[\s_-]?",
}
#: Values looked at for the type of a column: the feature is a bounded look.
LOOKED_AT = 100
KEPT_TYPES = ("none", "postcode", "city")


def type_by_name(name: str) -> str | None:
    return next((kind for kind, pattern in NAME_PATTERNS.items() if re.search(pattern, name, re.IGNORECASE)), None)


def _decide(x: dict, numeric: bool) -> str:
    n = x["n"] or 0
    if not n:
        return "none"
    if x["email"] > 0.3:
        return "email"
    if x["phone"] > 0.3:
        return "phone"
    if numeric and n >= 2 and x["precise"] > 0.7:
        if x["most"] <= 90:
            return "gps_lat"
        if x["most"] <= 180:
            return "gps_lon"
    if x["postcode"] > 0.5:
        return "postcode"
    return "none"


def detect_types(df: DataFrame, forced: Mapping[str, str] | None = None) -> dict[str, str]:
    """The kind of personal data of each column, ``none`` where there is none.

    Names decide first, then the first non-null values (``LOOKED_AT`` of them), for numbers also decimals and range of all values, and last the
    share of distinct values among all rows. The looks of all columns are one job, and so are the counts.
    """
    df, out, forced = clean(df), {}, forced or {}
    kinds = {f.name: f.dataType for f in df.schema}
    open_columns = []
    for c in scalar_columns(df):
        kind = forced.get(c) or type_by_name(c)
        if kind:
            out[c] = kind
        else:
            open_columns.append(c)
    share = lambda cond: F.avg(cond.cast("int"))
    heads = None
    for i, c in enumerate(open_columns):
        head = df.where(F.col(c).isNotNull()).select(F.col(c).cast("string").alias("v")).limit(LOOKED_AT)
        head = head.agg(F.lit(i).alias("i"), F.count("v").alias("n"), share(F.col("v").rlike(P.EMAIL)).alias("email"), share(F.col("v").rlike(P.PHONE)).alias("phone"), share(F.col("v").rlike(r"^\d{5}$")).alias("postcode"))
        heads = head if heads is None else heads.union(head)
    found = {open_columns[r.i]: r.asDict() for r in heads.collect()} if heads is not None else {}
    numeric = [c for c in open_columns if is_number(kinds[c])]
    if numeric:
        # Decimals and range of all values, and the exact count of distinct ones.
        decimals = lambda c: F.length(F.regexp_extract(F.col(c).cast("double").cast("string"), r"\.(\d*?)0*$", 1))
        one = df.agg(F.count("*").alias("rows"), *(x for i, c in enumerate(numeric) for x in (share(decimals(c) >= 4).alias(f"p{i}"), F.max(F.abs(F.col(c).cast("double"))).alias(f"m{i}")))).first()
        distinct = {r["column"]: r.k for r in frequencies(df, numeric).groupBy("column").agg(F.count("*").alias("k")).collect()}
        for i, c in enumerate(numeric):
            found[c] |= {"precise": one[f"p{i}"] or 0.0, "most": one[f"m{i}"]}
    for c in open_columns:
        out[c] = _decide(found[c], c in numeric)
        if out[c] == "none" and c in numeric and one["rows"] >= 20 and distinct.get(c, 0) / one["rows"] > 0.95:
            out[c] = "numeric_id"
    return {c: out[c] for c in scalar_columns(df)}


def hidden(column: str, kind: str, data_type: T.DataType, salt: str) -> Column:
    """The expression that hides a column of a kind."""
    value = F.col(column)
    text = value.cast("string")
    if kind in ("name", "id_direct", "numeric_id"):
        return P.pseudonym(text, salt)
    if kind in ("email", "phone"):
        return P.mask(value)
    if kind == "address":
        return P.generalise_address(text)
    if kind in ("gps_lat", "gps_lon"):
        return F.round(value, 2) if is_number(data_type) else P.round_position(text)
    if kind == "date_precise":
        return P.month_of(value) if isinstance(data_type, (T.DateType, T.TimestampType)) else P.generalise_date(text)
    if kind == "free_text":
        return P.scrub(text)
    return value


def anonymise(df: DataFrame, types: Mapping[str, str], salt: str) -> DataFrame:
    """All columns hidden by their kinds, in one projection."""
    return df.select(*(hidden(f.name, types.get(f.name, "none"), f.dataType, salt).alias(f.name) for f in df.schema))


def treatment_log(df: DataFrame, types: Mapping[str, str], salt: str) -> DataFrame:
    """(column, kind, n_values, n_treated): non-null values, and those that the treatment changes."""
    kinds = {f.name: f.dataType for f in df.schema}
    names = [c for c in types if c in kinds]
    counts = df.agg(*(x for i, c in enumerate(names) for x in (F.count(c).alias(f"n{i}"), F.count_if(F.col(c).isNotNull() & ~F.col(c).cast("string").eqNullSafe(hidden(c, types[c], kinds[c], salt).cast("string"))).alias(f"t{i}"))))
    rows = [F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("kind"), F.col(f"n{i}").alias("n_values"), F.col(f"t{i}").alias("n_treated")) for i, c in enumerate(names)]
    return counts.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def log_totals(log: DataFrame) -> DataFrame:
    """One row: columns, columns of personal data, treated values."""
    return log.agg(F.count("*").alias("n_columns"), F.count_if(F.col("kind") != "none").alias("n_personal"), F.coalesce(F.sum("n_treated"), F.lit(0)).alias("n_treated"))


def key_table(df: DataFrame, column: str, salt: str) -> DataFrame:
    """(value, pseudonym) of each distinct value, to be kept in a restricted place."""
    return df.select(F.col(column).cast("string").alias("value")).where("value is not null").distinct().select("value", P.pseudonym(F.col("value"), salt).alias("pseudonym"))


def renamed(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Columns as VAR_01, VAR_02, ... by position, and the map from the original names."""
    names = {c: f"VAR_{i:02d}" for i, c in enumerate(df.columns, 1)}
    return df.toDF(*names.values()), names


def strategy_document(log: DataFrame, names: Mapping[str, str] | None = None) -> str:
    """The treatment log as a Markdown table; one row a column is read."""
    lines = ["| column | kind | values | treated |", "| --- | --- | ---: | ---: |"]
    lines += [f"| {(names or {}).get(r['column'], r['column'])} | {r.kind} | {r.n_values} | {r.n_treated} |" for r in log.collect()]
    return "\n".join(lines) + "\n"
