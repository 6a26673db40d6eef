"""Mergeable sums of numeric columns, and exact quantiles by refinement of value ranges.

``ranges`` is one pass over the data: each column is counted by ranges of values, with the least and greatest value and the central moments of each range. Moments of whole columns follow from these few
rows, and so do the ranges that hold the quantiles. ``quantiles`` then counts only what lies in such a range, by parts of it, until a part holds one value; so no task holds the
distinct values of a column. The first ranges are of equal width on a logarithmic scale, six percent of the value each, whatever the column: they need no look at the data before, and outliers don't widen them. A range
of up to ``FEW`` rows is counted by value.

Values are doubles without NaN. A quantile lies between the two values next to its place, by the place's fraction.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sondage.operators.types import clean
from sondage.sources.staging import Staging

#: Ranges by the natural logarithm, and the parts of a range that is refined.
PER_E, PARTS = 16, 4096
#: Rows of a range that are counted by value.
FEW = 100_000
#: Ranges that are sent to all tasks.
MOST_SENT = 100_000


def range_of(x: Column) -> Column:
    """A number of the range that holds ``x``; it never falls as ``x`` grows."""
    scale = lambda v: F.least(F.ln(v) + 746, F.lit(2000.0))  # noqa: E731  # The logarithm of the least double is -744.5.
    return F.floor(PER_E * F.when(x > 0, scale(x)).when(x < 0, -scale(-x)).when(x == 0, 0.0)).cast("int")


def long_form(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, x), booleans as 0 and 1."""
    df = clean(df)
    values = [F.struct(F.lit(c).alias("column"), (F.col(c).cast("int") if df.schema[c].dataType.typeName() == "boolean" else F.col(c)).cast("double").alias("x")) for c in columns]
    return df.select(F.inline(F.array(*values)))


def ranges(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., range, n, lo, hi, mean, m2, m3, m4) of ``rows`` (keys..., x): central sums of powers. Nulls are counted in a range that is null. One aggregation."""
    found = rows.groupBy(*keys, range_of(F.col("x")).alias("range")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.avg("x").alias("mean"), F.var_pop("x").alias("v"), F.skewness("x").alias("g1"), F.kurtosis("x").alias("g2"))
    n = F.col("n")
    spread = F.when(F.col("lo") < F.col("hi"), F.coalesce(F.nanvl(F.col("v"), F.lit(0.0)), F.lit(0.0))).otherwise(0.0)
    third = F.coalesce(F.nanvl(F.col("g1"), F.lit(0.0)), F.lit(0.0)) * spread * F.sqrt(spread) * n
    fourth = F.when(spread > 0, (F.coalesce(F.nanvl(F.col("g2"), F.lit(0.0)), F.lit(0.0)) + 3) * spread * spread * n).otherwise(0.0)
    return found.select(*keys, "range", "n", "lo", "hi", "mean", (spread * n).alias("m2"), third.alias("m3"), fourth.alias("m4"))


def column_ranges(df: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of ``ranges`` by ``column``, as a written table."""
    return Staging(df.sparkSession, "summary").put(ranges(long_form(df, columns), ["column"]), "ranges")


def moments(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., n, lo, hi, mean, std, g1, g2) from the rows of ``ranges``: population skewness and excess kurtosis, null for a constant. Without values there is no row."""
    found = found.where("range is not null")
    n = F.col("n")
    total = found.groupBy(*keys).agg(F.sum("n").alias("total"), (F.sum(n * F.col("mean")) / F.sum("n")).alias("middle"))
    d = F.col("mean") - F.col("middle")
    rows = found.join(total, keys).select("*", d.alias("d"))
    d, m2, m3, m4 = (F.col(c) for c in ("d", "m2", "m3", "m4"))
    sums = rows.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
        F.first("middle").alias("mean"),
        F.sum(m2 + n * d * d).alias("s2"),
        F.sum(m3 + 3 * d * m2 + n * d * d * d).alias("s3"),
        F.sum(m4 + 4 * d * m3 + 6 * d * d * m2 + n * d * d * d * d).alias("s4"),
    )
    varied = (F.col("lo") < F.col("hi")) & (F.col("s2") > 0)
    v = F.col("s2") / n
    return sums.select(*keys, "n", "lo", "hi", "mean", F.when(n > 1, F.sqrt(F.col("s2") / (n - 1))).alias("std"), F.when(varied, F.col("s3") / n / (v * F.sqrt(v))).alias("g1"), F.when(varied, F.col("s4") / n / (v * v) - 3).alias("g2"))


def quantiles(rows: DataFrame, keys: list[str], probabilities: list[float], first: DataFrame | None = None, weight: str | None = None) -> DataFrame:
    """(keys..., p, value): the quantiles of ``x`` by key of ``rows`` (keys..., x), exact. There is at least one key.

    ``first`` are the rows of ``ranges`` if they are at hand; ``weight`` names a column of whole numbers that tells how often a row counts. Rows are read once a round.
    """
    stage = Staging(rows.sparkSession, "quantiles")
    times = F.sum(weight) if weight else F.count("*")
    if first is None:
        first = rows.where("x is not null").groupBy(*keys, range_of(F.col("x")).alias("range")).agg(times.alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).where("n > 0")
    now = stage.put(first.where("range is not null").select(*keys, F.col("range").cast("double").alias("part"), "n", "lo", "hi"), "ranges")
    place = (F.col("total") - 1) * F.col("p")
    totals = now.groupBy(*keys).agg(F.sum("n").alias("total")).withColumn("p", F.explode(F.array(*(F.lit(float(p)) for p in probabilities))))
    wanted = stage.put(totals.select(*keys, "p", F.floor(place).alias("below"), F.ceil(place).alias("above"), (place - F.floor(place)).alias("share")), "wanted")
    # Places that are looked for: the range that holds one, and how many values of the range come before it.
    places = wanted.select(*keys, F.explode(F.array_distinct(F.array("below", "above"))).alias("place")).distinct()
    held = places.select(*keys, "place", F.col("place").alias("inside"), F.lit(-math.inf).alias("from"))
    now = now.withColumn("from", F.lit(-math.inf))
    done = None
    while True:
        order = Window.partitionBy(*keys, "from").orderBy("part")  # the parts of a range
        parts = now.withColumn("before", F.sum("n").over(order) - F.col("n"))
        found = held.join(parts, [*keys, "from"]).where("before <= inside and inside < before + n")
        found = stage.put(found.select(*keys, "place", (F.col("inside") - F.col("before")).alias("inside"), "lo", "hi", "n"), "found")
        values = found.where("lo = hi").select(*keys, "place", F.col("lo").alias("value"))
        done = values if done is None else done.union(values)
        held = found.where("lo < hi").select(*keys, "place", "inside", F.col("lo").alias("from"), F.col("hi").alias("to"), "n")
        if held.isEmpty():
            break
        open_ = stage.put(held.select(*keys, "from", "to", F.col("n").alias("size")).distinct(), "open")
        inside = rows.join(F.broadcast(open_) if open_.count() <= MOST_SENT else open_, keys).where("x between from and to")
        part = F.when(F.col("size") <= FEW, F.col("x")).otherwise(F.least(F.floor(PARTS * ((F.col("x") - F.col("from")) / (F.col("to") - F.col("from")))), F.lit(PARTS - 1)).cast("double"))
        now = stage.put(inside.groupBy(*keys, "from", part.alias("part")).agg(times.alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).where("n > 0"), "parts")
        held = held.select(*keys, "place", "inside", "from")
    below, above = (done.select(*keys, F.col("place").alias(c), F.col("value").alias(f"{c}_value")) for c in ("below", "above"))
    out = wanted.join(below, [*keys, "below"]).join(above, [*keys, "above"])
    share = F.col("share")
    value = F.when((share == 0) | (F.col("below_value") == F.col("above_value")), F.col("below_value")).otherwise((1 - share) * F.col("below_value") + share * F.col("above_value"))
    return stage.put(out.select(*keys, "p", value.alias("value")), "values")


def column_quantiles(df: DataFrame, columns: list[str], probabilities: list[float]) -> dict[str, dict[float, float]]:
    """The quantiles of columns by name and probability; columns without values are left out. One row a column and probability comes to the driver."""
    out: dict[str, dict[float, float]] = {}
    for r in quantiles(long_form(df, columns), ["column"], probabilities).collect() if columns else []:
        out.setdefault(r["column"], {})[r["p"]] = r["value"]
    return out
