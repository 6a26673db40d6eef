"""Composite importance of columns: completeness, variability, greatest correlation and uniqueness."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sondage.operators import summary
from sondage.operators.correlation import correlations, strongest
from sondage.operators.profile import frequencies
from sondage.operators.types import clean, numeric_columns, scalar_columns

# The weights of the score.
WEIGHTS = {"completeness": 0.30, "variability": 0.35, "corr_max": 0.20, "uniqueness": 0.15}
EPSILON = 1e-9
WEAK = 25


def importance(df: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(column, completeness, variability, corr_max, uniqueness, score, rank): the components in percent with one decimal.

    Variability is the coefficient of variation of a numeric column, clipped to 1, and else the entropy of the values against its
    greatest possible value. ``found`` are the rows of ``summary.column_ranges`` of the numeric columns if they are at hand.
    """
    df = clean(df)
    names, numeric = scalar_columns(df), numeric_columns(df)
    counts = frequencies(df, names).select("column", "times")
    by_column = counts.groupBy("column").agg(F.sum("times").alias("n"), F.count("*").alias("n_distinct"))
    entropy = counts.join(F.broadcast(by_column), "column")  # one row a column
    p = F.col("times") / F.col("n")
    entropy = entropy.groupBy("column").agg((-F.sum(p * F.log2(p + EPSILON))).alias("entropy"))
    rows = df.agg(F.count("*").alias("rows"))
    base = df.sparkSession.createDataFrame([(c,) for c in names], "column string").join(F.broadcast(rows))
    base = base.join(by_column, "column", "left").join(entropy, "column", "left")
    if numeric:
        spread = summary.moments(summary.column_ranges(df, numeric) if found is None else found, ["column"])
        ratio = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("std") / (F.abs("mean") + EPSILON)))
        spread = spread.select("column", F.coalesce(ratio, F.lit(0.0)).alias("cv"))
        base = base.join(spread, "column", "left").withColumn("cv", F.when(F.col("column").isin(numeric), F.coalesce("cv", F.lit(0.0))))
    else:
        base = base.withColumn("cv", F.lit(None).cast("double"))
    if len(numeric) > 1:
        base = base.join(strongest(correlations(df, numeric)), "column", "left")
    else:
        base = base.withColumn("corr_max", F.lit(None).cast("double"))
    n, distinct = F.coalesce("n", F.lit(0)), F.coalesce("n_distinct", F.lit(0))
    most = F.log2(F.greatest(distinct, F.lit(1)))
    variability = F.coalesce("cv", F.when(most > 0, F.col("entropy") / most).otherwise(0.0))
    parts = base.select(
        "column",
        (n / F.greatest("rows", F.lit(1))).alias("completeness"),
        variability.alias("variability"),
        F.coalesce("corr_max", F.lit(0.0)).alias("corr_max"),
        (distinct / F.greatest("rows", F.lit(1))).alias("uniqueness"),
    )
    score = sum(F.col(k) * w for k, w in WEIGHTS.items())
    scored = parts.select("column", *(F.round(100 * F.col(k), 1).alias(k) for k in WEIGHTS), F.round(100 * score, 1).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "column")))  # one row a column


def top_importance(scores: DataFrame, n: int) -> DataFrame:
    if n < 1:
        raise ValueError("n must be at least 1")
    return scores.orderBy("rank").limit(n)


def decomposition(scores: DataFrame) -> DataFrame:
    """(column, component, value, weight, points) of each part of the score."""
    parts = [F.struct(F.lit(k).alias("component"), F.col(k).alias("value"), F.lit(w).alias("weight"), F.round(F.col(k) * w, 2).alias("points")) for k, w in WEIGHTS.items()]
    return scores.select("column", F.explode(F.array(*parts)).alias("x")).select("column", "x.*")


def variables(profile: DataFrame, scores: DataFrame) -> DataFrame:
    """The profile of each column with its score; columns without one come last."""
    return profile.join(scores.select("column", "score", "rank"), "column", "left").orderBy(F.asc_nulls_last("rank"), "column")


def narrative(scores: DataFrame) -> list[str]:
    """A few sentences about the scores. One row a column is read."""
    rows = [r.asDict() for r in scores.orderBy("rank").collect()]
    if not rows:
        return []
    n = len(rows)
    mean = sum(r["score"] for r in rows) / n
    sd = (sum((r["score"] - mean) ** 2 for r in rows) / max(n - 1, 1)) ** 0.5
    out = [f"{n} columns have a mean score of {mean:.1f} (standard deviation {sd:.1f}): they are {'unequal' if sd > 15 else 'alike'} in importance."]
    means = {k: sum(r[k] for r in rows) / n for k in WEIGHTS}
    driver = max(means, key=lambda k: means[k] * WEIGHTS[k])
    out.append(f"{driver} adds most to the scores, with {means[driver]:.1f} percent on average.")
    if n >= 3:
        out.append("Most important: " + ", ".join(f"{r['column']} ({r['score']})" for r in rows[:3]) + ".")
    weak = [r for r in rows if r["score"] < WEAK]
    if weak:
        why = lambda r: " and ".join(x for x in ("incomplete" * (r["completeness"] < 50), "hardly variable" * (r["variability"] < 10)) if x) or "low in all parts"
        out.append("Weak: " + ", ".join(f"{r['column']} ({why(r)})" for r in weak) + ".")
    if means["corr_max"] < 30:
        out.append("The columns are hardly correlated with each other.")
    out.append(f"Least important: {rows[-1]['column']} ({rows[-1]['score']}).")
    return out
