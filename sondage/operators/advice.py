"""Advice before clustering: fitness of the data, ranking of algorithms, encoding of text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sondage.operators.profile import frequencies, table_profile
from sondage.operators.types import clean, numeric_columns, scalar_columns, text_columns

# Words of ordinal scales; two of them make a column ordinal.
ORDINAL_WORDS = [
    "low", "medium", "high", "bas", "moyen", "haut", "faible", "fort", "small", "large",
    "never", "rarely", "sometimes", "often", "always", "jamais", "rarement", "souvent", "toujours",
    "très", "peu", "1", "2", "3", "4", "5", "excellent", "bon", "mauvais", "très bon",
]
ALGORITHMS = ("kmeans", "dbscan", "agglomerative", "gmm", "meanshift")


def fitness_measures(df: DataFrame) -> DataFrame:
    """One row: rows, missing percent (mean over columns), duplicates and their percent, constant and nearly constant numeric columns."""
    df = clean(df)
    names, numeric = scalar_columns(df), numeric_columns(df)
    base = table_profile(df).select("n_rows", F.round(100 * F.col("n_missing") / F.greatest("n_cells", F.lit(1)), 2).alias("missing_pct"), "n_duplicates", F.round(100 * F.col("n_duplicates") / F.greatest("n_rows", F.lit(1)), 2).alias("duplicate_pct"))
    if numeric:
        counts = frequencies(df, numeric).groupBy("column").agg(F.count("*").alias("values"), F.max("times").alias("most"), F.sum("times").alias("n"))
        odd = counts.agg(F.count_if(F.col("values") <= 1).alias("n_constant"), F.count_if((F.col("values") > 1) & (F.col("most") / F.col("n") > 0.95)).alias("n_nearly_constant"))
    else:
        odd = df.sparkSession.range(1).select(F.lit(0).cast("long").alias("n_constant"), F.lit(0).cast("long").alias("n_nearly_constant"))
    return base.join(odd).select("*", F.lit(len(numeric)).alias("n_numeric"), F.lit(len([c for c in names if c in text_columns(df)])).alias("n_text"))


def fitness(measures: DataFrame) -> DataFrame:
    """The measures with blockers, warnings, a score from 0 to 100 and a status."""
    some = lambda c: c.cast("int")
    n, miss, dup = F.col("n_rows"), F.col("missing_pct"), F.col("duplicate_pct")
    blockers = some(n < 10) + some(F.col("n_numeric") == 0) + some(miss > 50)
    warnings = some((n >= 10) & (n < 50)) + some(F.col("n_numeric") == 1) + some((miss > 20) & (miss <= 50)) + some(dup > 20) + some(F.col("n_constant") > 0)
    infos = some((miss > 0) & (miss <= 20)) + some((dup > 5) & (dup <= 20)) + some(F.col("n_nearly_constant") > 0) + some(F.col("n_text") > 0)
    rows = measures.withColumns({"n_blockers": blockers, "n_warnings": warnings, "n_infos": infos})
    score = F.greatest(F.lit(0), F.least(F.lit(100), 100 - 40 * F.col("n_blockers") - 15 * F.col("n_warnings")))
    status = F.when(F.col("n_blockers") > 0, "bad").when(F.col("n_warnings") > 0, "warn").otherwise("ok")
    return rows.withColumns({"score": score, "status": status})


# Points of each algorithm.
def algorithm_scores(n: Column, features: Column, miss: Column) -> dict[str, Column]:
    when = lambda c, yes, no=0: F.when(c, yes).otherwise(no)
    return {
        "kmeans": F.least(F.lit(95), 85 + when(n > 500, 5) - when(features > 30, 10)),
        "dbscan": F.least(F.lit(90), 75 + when(n < 20000, 5, -15) - when(miss > 10, 5)),
        "agglomerative": F.least(F.lit(85), 70 + when(n <= 2000, 10, -20)),
        "gmm": F.least(F.lit(85), 70 + when(n >= 100, 5, -15) - when(features > n, 20)),
        "meanshift": F.least(F.lit(75), 60 - when(n > 3000, 30)),
    }


def algorithm_ranking(measures: DataFrame, features: int | None = None) -> DataFrame:
    """(algorithm, score, rank), the most suitable first; ties in the order of ``ALGORITHMS``."""
    scores = algorithm_scores(F.col("n_rows"), F.col("n_numeric") if features is None else F.lit(features), F.col("missing_pct"))
    rows = measures.select(F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(a).alias("algorithm"), scores[a].cast("int").alias("score")) for i, a in enumerate(ALGORITHMS)))).alias("x")).select("x.*")
    return rows.select("algorithm", "score", F.row_number().over(Window.orderBy(F.desc("score"), "i")).alias("rank")).orderBy("rank")


def encoding_plan(df: DataFrame) -> DataFrame:
    """(column, n_distinct, encoding, priority) of text columns, in order of priority."""
    df = clean(df)
    columns = text_columns(df)
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, n_distinct long, encoding string, priority string")
    counts = frequencies(df, columns).groupBy("column", F.lower("value").alias("value")).agg(F.count("*").alias("k"))
    rows = counts.groupBy("column").agg(F.sum("k").alias("n_distinct"), F.count_if(F.col("value").isin(ORDINAL_WORDS)).alias("words"))
    rows = df.sparkSession.createDataFrame([(c,) for c in columns], "column string").join(rows, "column", "left").fillna(0, ["n_distinct", "words"])
    d = F.col("n_distinct")
    encoding = F.when(d == 2, "label").when(F.col("words") >= 2, "ordinal").when(d <= 30, "one-hot").when(d <= 100, "frequency").otherwise("drop or group")
    priority = F.when(d == 2, "high").when(F.col("words") >= 2, "high").when(d <= 10, "high").when(d <= 100, "medium").otherwise("low")
    order = F.when(F.col("priority") == "high", 0).when(F.col("priority") == "medium", 1).otherwise(2)
    return rows.select("column", "n_distinct", encoding.alias("encoding"), priority.alias("priority")).orderBy(order, "column")
