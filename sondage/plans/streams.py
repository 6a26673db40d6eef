"""The windowed profile of a stream, as the same query over the table of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from sondage.plans.base import query, table
from sondage.streaming.profile import windowed_profile


@query("windowed_profile", "SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(value) AS n, count(*) - count(value) AS n_missing, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min, max(value) AS max FROM events GROUP BY 1, 2")
def windowed(spark, sf_dir):
    rows = windowed_profile(table(spark, sf_dir, "events"), "ts", "event_type", "value")
    return rows.select("start", "event_type", "n", "n_missing", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "min", "max")
