"""Pairwise-complete Pearson correlations of all pairs from sums of products, which partitions add up for themselves."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage.operators.types import WrongKind, clean, number, numeric_columns

STRONG = 0.7


def correlations(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(a, b, r) of each unordered pair of numeric columns; r is null where a variance is zero.

    Two passes, whatever the number of columns: the least values, from which the others are counted so that sums stay exact, and the sums. Every
    partition gives one row a pair.
    """
    df = clean(df)
    columns = columns or numeric_columns(df)
    if len(columns) < 2:
        raise WrongKind("fewer than two numeric columns")
    names = [f"x{i}" for i in range(len(columns))]
    x = df.select(*(number(c).alias(h) for c, h in zip(columns, names, strict=True)))
    least = x.agg(*(F.min(h).alias(f"m{h}") for h in names))  # one row
    x = x.join(F.broadcast(least)).select(*((F.col(h) - F.col(f"m{h}")).alias(h) for h in names))
    first, second = np.triu_indices(len(columns), 1)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, len(first)))
        for batch in batches:
            v = np.column_stack([np.asarray(c.fill_null(np.nan).to_numpy(zero_copy_only=False), float) for c in batch.columns])
            held = ~np.isnan(v)
            v, w = np.where(held, v, 0.0), held.astype(float)
            # Of a pair (a, b): rows with both, sums of a, b, aa, bb, ab over these.
            found = (w.T @ w, v.T @ w, w.T @ v, (v * v).T @ w, w.T @ (v * v), v.T @ v)
            total += np.stack([m[first, second] for m in found])
        yield pa.RecordBatch.from_arrays([pa.array(first), pa.array(second), *map(pa.array, total)], ["i", "j", "n", "a", "b", "aa", "bb", "ab"])

    found = x.mapInArrow(sums, "i long, j long, n double, a double, b double, aa double, bb double, ab double")
    found = found.groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in ("n", "a", "b", "aa", "bb", "ab")))
    n, c = F.nullif("n", F.lit(0.0)), F.col
    spread = lambda s, q: F.when(c(q) - c(s) * c(s) / n > 1e-12 * c(q), c(q) - c(s) * c(s) / n)
    r = (c("ab") - c("a") * c("b") / n) / F.sqrt(spread("a", "aa") * spread("b", "bb"))
    label = F.lit(columns)
    pairs = df.sparkSession.createDataFrame([(i, j) for i, j in combinations(range(len(columns)), 2)], "i long, j long")
    return pairs.join(F.broadcast(found.select("i", "j", F.when(r > 1, 1.0).when(r < -1, -1.0).otherwise(r).alias("r"))), ["i", "j"], "left").select(label[c("i").cast("int")].alias("a"), label[c("j").cast("int")].alias("b"), "r")


def matrix(pairs: DataFrame) -> DataFrame:
    """(a, b, r) in both directions, with the diagonal."""
    names = pairs.select(F.explode(F.array("a", "b")).alias("a")).distinct()
    return pairs.union(pairs.select("b", "a", "r")).union(names.select("a", F.col("a"), F.lit(1.0)))


def ranked_pairs(pairs: DataFrame, least: float = 0.0) -> DataFrame:
    """(a, b, strength, r) by strength, from ``least`` on."""
    return pairs.where("r is not null").select("a", "b", F.round(F.abs("r"), 4).alias("strength"), "r").where(F.col("strength") >= least).orderBy(F.desc("strength"), "a", "b")


def strongest(pairs: DataFrame) -> DataFrame:
    """(column, corr_max): the greatest absolute correlation of each column with another."""
    sides = pairs.select(F.col("a").alias("column"), "r").union(pairs.select("b", "r"))
    return sides.groupBy("column").agg(F.max(F.abs("r")).alias("corr_max"))
