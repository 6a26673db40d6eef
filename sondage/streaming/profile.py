"""Profiles of a stream: mergeable moments by window and kind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_profile(stream: DataFrame, time: str, group: str, value: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, end, group, n, n_missing, mean, std, min, max) by tumbling window. Works on a stream and on a table alike."""
    rows = stream.withColumn(time, F.col(time).cast("timestamp"))  # a timestamp without a time zone can't bear a watermark
    rows = rows.withWatermark(time, late) if stream.isStreaming else rows
    x = F.col(value).cast("double")
    x = F.when(~F.isnan(x), x)
    out = rows.groupBy(F.window(time, window), group).agg(F.count("*").alias("rows"), F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), group, "n", (F.col("rows") - F.col("n")).alias("n_missing"), "mean", "std", "min", "max")
