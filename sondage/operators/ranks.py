"""Places of values in the order of a whole column, without a task that sorts it.

Distinct values are dealt into ranges whose bounds are quantiles of a sample, so that outliers don't fill a range with all other values; the counts of the ranges before are added to the running counts
inside a range. Equal values are one row until they are wanted one by one, so a frequent value is no large range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sondage.operators.types import clean, number
from sondage.sources.staging import Staging

#: Distinct values of a range: at least, while there are fewer ranges than ``MANY``, and about, once there are more.
LEAST, ABOUT, MANY = 128, 1_000_000, 1024
#: Equal values that are written out at once.
AT_ONCE = 65_536


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """(x, times) of the non-null values of a column."""
    return clean(df).select(number(column).alias("x")).where("x is not null").groupBy("x").agg(F.count("*").alias("times"))


def in_ranges(values: DataFrame, stage: Staging) -> DataFrame:
    """``values`` (x, times) with ``part``, the range that holds them; ranges ascend."""
    values = stage.put(values, "values")
    count = values.count()
    parts = max(1, min(MANY, count // LEAST), count // ABOUT)
    return stage.put(values.repartitionByRange(parts, "x").withColumn("part", F.spark_partition_id()), "ranges")


def places(values: DataFrame, stage: Staging) -> DataFrame:
    """(x, times, before, n) of ``values`` (x, times): how many are smaller, and how many there are."""
    rows = in_ranges(values, stage)
    sizes = rows.groupBy("part").agg(F.sum("times").alias("size"))
    # One row a range.
    sizes = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("first"), F.sum("size").over(Window.partitionBy()).alias("n"))
    inside = F.sum("times").over(Window.partitionBy("part").orderBy("x")) - F.col("times")
    return rows.withColumn("inside", inside).join(F.broadcast(sizes), "part").select("x", "times", (F.col("first") + F.col("inside")).alias("before"), "n")


def one_by_one(found: DataFrame, stage: Staging) -> DataFrame:
    """(x, n, i) from the rows of ``places``: a row for each of equal values, with its place from 1 on."""
    found = stage.put(found, "places")
    rows = found.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1, F.lit(AT_ONCE).cast("long"))))
    if (found.agg(F.max("times")).first()[0] or 0) > AT_ONCE:
        rows = rows.repartition("x", "chunk")
    first = F.col("before") + F.col("chunk") + 1
    last = F.col("before") + F.least(F.col("chunk") + AT_ONCE, F.col("times"))
    return rows.select("x", "n", F.explode(F.sequence(first, last)).alias("i"))
