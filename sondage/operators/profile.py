"""Table and column profiles, value frequencies, histograms, box plots and outliers.

Each analysis is an aggregation over the data in one pass, or one after a first pass over a few statistics, and returns a
tidy DataFrame. Nothing depends on the number of rows but the pass itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondage.functions.stats import adjusted_kurtosis, adjusted_skew
from sondage.operators import ranks, summary
from sondage.operators.types import clean, is_stat_numeric, need, nested_keys, number, numeric_columns, scalar_columns, text_columns
from sondage.sources.staging import Staging

MOST_BINS, TOP_VALUES, MOST_OUTLIERS = 20, 20, 200
FEW_CODES = 12


def table_profile(df: DataFrame) -> DataFrame:
    """One row: rows, columns, cells, missing cells, completeness, duplicate rows, counts of numeric and text columns."""
    df = clean(df)
    names = scalar_columns(df)
    missing = sum((F.col(c).isNull().cast("long") for c in names), F.lit(0).cast("long"))
    # Equal rows are counted together first, so that one pass gives both the totals and the duplicates.
    rows = df.groupBy(*names, *nested_keys(df)).agg(F.count("*").alias("times")).select("times", (missing * F.col("times")).alias("missing"))
    out = rows.agg(F.coalesce(F.sum("times"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum("missing"), F.lit(0)).alias("n_missing"), F.count("*").alias("n_distinct"))
    cells = F.col("n_rows") * len(names)
    completeness = F.round(100 * (1 - F.col("n_missing") / F.greatest(cells, F.lit(1))), 2)
    return out.select(
        "n_rows",
        F.lit(len(names)).alias("n_columns"),
        cells.alias("n_cells"),
        "n_missing",
        completeness.alias("completeness"),
        (F.col("n_rows") - F.col("n_distinct")).alias("n_duplicates"),
        F.lit(len(numeric_columns(df))).alias("n_numeric"),
        F.lit(len(text_columns(df))).alias("n_text"),
    )


def frequencies(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, value, number, times) of all non-null values: number orders the values of numeric columns.

    The columns of a type are one aggregation over values as they are; only what is counted becomes text.
    """
    df = clean(df)
    kinds: dict[str, list[str]] = {}
    for c in columns or scalar_columns(df):
        kinds.setdefault(df.schema[c].dataType.simpleString(), []).append(c)
    out = None
    for names in kinds.values():
        cells = F.array(*(F.struct(F.lit(i).alias("i"), F.col(c).alias("v")) for i, c in enumerate(names)))
        counts = df.select(F.explode(cells).alias("x")).select("x.*").where("v is not null").groupBy("i", "v").agg(F.count("*").alias("times"))
        number_ = F.col("v").cast("double") if is_stat_numeric(df.schema[names[0]].dataType) else F.lit(None).cast("double")
        rows = counts.select(F.lit(names)[F.col("i")].alias("column"), F.col("v").cast("string").alias("value"), number_.alias("number"), "times")
        out = rows if out is None else out.union(rows)
    return out


def missing_report(df: DataFrame) -> DataFrame:
    """(column, n_missing, completeness, status) with the least complete first."""
    df = clean(df)
    names = scalar_columns(df)
    counts = df.agg(F.count("*").alias("n"), *(F.count(c).alias(f"c{i}") for i, c in enumerate(names)))
    rows = counts.select("n", F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("present")) for i, c in enumerate(names)))).alias("x")).select("n", "x.*")
    share = F.round(100 * F.col("present") / F.greatest(F.col("n"), F.lit(1)), 1)
    rows = rows.select("column", (F.col("n") - F.col("present")).alias("n_missing"), share.alias("completeness"))
    return rows.withColumn("status", missing_status(F.col("completeness"))).orderBy("completeness", "column")


def missing_status(completeness: Column) -> Column:
    return F.when(completeness >= 80, "ok").when(completeness >= 50, "attention").otherwise("critical")


def numeric_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row a numeric or boolean column: counts, range, mean, median, standard deviation, adjusted skewness and kurtosis.

    All columns are counted and summed by ranges of values in one pass; the medians then look into the ranges that hold them.
    """
    columns = columns or [f.name for f in df.schema if is_stat_numeric(f.dataType)]
    need(df, *columns)
    found = summary.column_ranges(df, columns)
    medians = summary.quantiles(summary.long_form(df, columns), ["column"], [0.5], found).select("column", F.col("value").alias("median"))
    out = shape(found, columns).join(medians, "column", "left")
    r = lambda c: F.round(c, 4).alias(c)
    return out.select("column", "n", "n_missing", *(r(c) for c in ("min", "max", "mean", "median", "std", "skewness", "kurtosis")))


def shape(found: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, n_missing, min, max, mean, std, skewness, kurtosis, g1, g2) of ``columns`` from the rows of ``summary.column_ranges``. The tables have one row a column."""
    names = found.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    missing = found.where("range is null").select("column", F.col("n").alias("n_missing"))
    rows = names.join(summary.moments(found, ["column"]), "column", "left").join(missing, "column", "left")
    n = F.coalesce("n", F.lit(0))
    skew, kurtosis = adjusted_skew(n, F.col("g1")), adjusted_kurtosis(n, F.col("g2"), F.col("lo") == F.col("hi"))
    return rows.select("column", n.alias("n"), F.coalesce("n_missing", F.lit(0)).alias("n_missing"), F.col("lo").alias("min"), F.col("hi").alias("max"), "mean", "std", skew.alias("skewness"), kurtosis.alias("kurtosis"), "g1", "g2")


def column_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row a column: missing cells, completeness, distinct values and mode (of equals the smallest; null if all are missing)."""
    df = clean(df)
    columns = columns or scalar_columns(df)
    counts = frequencies(df, columns)
    best = F.min(F.struct((-F.col("times")).alias("a"), "number", "value"))
    values = counts.groupBy("column").agg(F.sum("times").alias("n"), F.count("*").alias("n_distinct"), best.alias("best"))
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    rows = df.agg(F.count("*").alias("rows"))
    out = names.join(values, "column", "left").join(F.broadcast(rows))  # one row
    n = F.coalesce("n", F.lit(0))
    return out.select("column", n.alias("n"), (F.col("rows") - n).alias("n_missing"), F.round(100 * n / F.greatest("rows", F.lit(1)), 1).alias("completeness"), F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"), F.col("best.value").alias("mode"))


def top_values(df: DataFrame, column: str, limit: int = TOP_VALUES) -> DataFrame:
    """(value, times) of the most frequent values; ties by value."""
    need(df, column)
    return clean(df).where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("times")).orderBy(F.desc("times"), "value").limit(limit)


def histogram(df: DataFrame, column: str, most: int = MOST_BINS) -> DataFrame:
    """(bin, lo, hi, times, density) in at most ``most`` equal bins from least to greatest; the last bin is closed.

    A constant column has its bins over half a unit to each side. An empty one has no bins.
    """
    need(df, column, numeric=True)
    x = clean(df).select(number(column).alias("x")).where("x is not null")
    spread = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n")).where("n > 0")
    flat = F.col("lo") == F.col("hi")
    spread = spread.select("n", F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"), F.least("n", F.lit(most)).cast("int").alias("bins"))
    spread = spread.withColumn("width", (F.col("hi") - F.col("lo")) / F.col("bins"))
    # One row of statistics.
    placed = x.join(F.broadcast(spread)).select(F.least(F.floor((F.col("x") - F.col("lo")) / F.col("width")), F.col("bins") - 1).cast("int").alias("bin"))
    counts = placed.groupBy("bin").agg(F.count("*").alias("times"))
    bins = spread.select("lo", "width", "n", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    times = F.coalesce("times", F.lit(0))
    return bins.join(counts, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("lo"), (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("hi"), times.alias("times"), (times / (F.col("n") * F.col("width"))).alias("density"))


def fences(df: DataFrame, column: str) -> DataFrame:
    """One row: least and greatest value, mean, quartiles and Tukey's fences; nulls without values."""
    found = summary.column_ranges(df, [column])
    values = summary.quantiles(summary.long_form(df, [column]), ["column"], [0.25, 0.5, 0.75], found)
    q = values.groupBy("column").agg(*(F.max(F.when(F.col("p") == p, F.col("value"))).alias(name) for p, name in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))))
    q = shape(found, [column]).join(q, "column", "left").select("min", "max", "mean", "q1", "median", "q3")
    return q.withColumns({"low": F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), "high": F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))})


def outliers(df: DataFrame, column: str) -> DataFrame:
    """All rows outside Tukey's fences."""
    need(df, column, numeric=True)
    # One row of fences.
    limits = F.broadcast(fences(df, column).select(F.col("low").alias("fence_low"), F.col("high").alias("fence_high")))
    return clean(df).join(limits).where((number(column) < F.col("fence_low")) | (number(column) > F.col("fence_high"))).drop("fence_low", "fence_high")


def box_plot(df: DataFrame, column: str) -> DataFrame:
    """One row: least, quartiles, greatest, mean and count of outliers."""
    need(df, column, numeric=True)
    limits = fences(df, column)
    x = clean(df).select(number(column).alias("x")).where("x is not null").join(F.broadcast(limits.select("low", "high")))
    n = x.agg(F.count_if((F.col("x") < F.col("low")) | (F.col("x") > F.col("high"))).alias("n_outliers"))
    return limits.join(n).select("min", "q1", "median", "q3", "max", "mean", "n_outliers")


def distribution_alerts(profile: DataFrame) -> DataFrame:
    """(column, alerts) from ``numeric_profile``: strong asymmetry, heavy tails, empty column."""
    alerts = F.array_compact(F.array(F.when(F.col("n") == 0, "empty"), F.when(F.abs("skewness") > 1, "asymmetric"), F.when(F.col("kurtosis") > 3, "heavy tails")))
    return profile.select("column", F.array_join(alerts, ", ").alias("alerts"))


def numbered(df: DataFrame, column: str) -> DataFrame:
    """(x, n, i): the non-null values of a column with their 1-based rank ``i`` and count ``n``; ranks are those of ``ranks.places``."""
    stage = Staging(df.sparkSession, "ranks")
    return ranks.one_by_one(ranks.places(ranks.distinct_values(df, column), stage), stage)
