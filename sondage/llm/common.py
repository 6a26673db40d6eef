"""Shared helpers: size-checked broadcasts and whole-table reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.sources.staging import Staging, shared_dir, small_batches

__all__ = ["BROADCAST_IDS", "Staging", "keep_ids", "shared_dir", "small_batches", "spread_join", "table"]

#: Most ids that an explicit broadcast may carry (16 bytes each, so 32 MB); above it, joins shuffle.
BROADCAST_IDS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_ids(df: DataFrame, ids: DataFrame, key: str = "doc_id", how: str = "left_semi") -> DataFrame:
    """Semi or anti join on ``key``. The ids are counted first: few are broadcast, so that ``df`` isn't shuffled."""
    ids = ids.select(key)
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, key, how)


def spread_join(df: DataFrame, side: DataFrame, keys: list[str], how: str = "inner", salts: int = 16) -> DataFrame:
    """``df`` joined to ``side``, a written table with one row a key, where many rows of ``df`` may share a key.

    ``side`` is counted: a small one is broadcast. Of a larger one each row meets ``salts`` parts of its key's rows, so that no task gets all of a hot key.
    """
    if side.count() <= BROADCAST_IDS // 4:
        return df.join(F.broadcast(side), keys, how)
    dealt = df.withColumn("__salt", F.pmod(F.xxhash64(*(c for c, kind in df.dtypes if not kind.startswith("map"))), F.lit(salts)).cast("int"))
    spread = side.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(spread, [*keys, "__salt"], how).drop("__salt")
