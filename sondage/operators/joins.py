"""Joins in which one key may hold many rows of the large side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a side that is sent to all tasks, and the parts that a key is dealt into where it is larger.
MOST_SENT, SALTS = 500_000, 16


def spread_join(df: DataFrame, side: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``df`` joined to ``side``, a written table with few rows a key. A side that is small by its count is broadcast; of a larger one each row meets ``SALTS`` parts of its key's rows."""
    if side.count() <= MOST_SENT:
        return df.join(F.broadcast(side), keys, how)
    dealt = df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)).cast("int"))
    return dealt.join(side.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*keys, "__salt"], how).drop("__salt")
