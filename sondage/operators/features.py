"""Feature preparation for clustering: one-hot codes, medians, scaling, principal components."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondage.operators import summary
from sondage.operators.types import clean, need, number, numeric_columns

#: Values of a column that get a code of their own; from one more on, the rest share one.
MOST_CODES = 20
REST = "__autre__"
SCALERS = ("standard", "robust", "minmax")


def codes(df: DataFrame, column: str, most: int = MOST_CODES) -> tuple[list[str], bool]:
    """The values with a code of their own, sorted, and whether the rest (nulls as well) share one. A bounded look."""
    rows = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("v")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "v").limit(most + 1).collect()
    crowded = len(rows) > most
    return sorted(r.v for r in rows[: most - 1 if crowded else most]), crowded


def collapsed(df: DataFrame, column: str, most: int = MOST_CODES) -> Column:
    """The column with rare values as ``REST``."""
    values, crowded = codes(df, column, most)
    text = F.col(column).cast("string")
    return F.when(text.isin(values), text).otherwise(F.lit(REST)) if crowded else text


def encoded(df: DataFrame, columns: list[str]) -> tuple[DataFrame, list[str]]:
    """0/1 columns ``<column>_<value>`` beside ``df``, and their names."""
    need(df, *columns)
    names: list[str] = []
    for c in columns:
        values, crowded = codes(df, c)
        text = F.col(c).cast("string")
        made = {f"{c}_{v}": F.coalesce((text == v).cast("double"), F.lit(0.0)) for v in values}
        if crowded:
            made[f"{c}_{REST}"] = F.when(text.isin(values), 0.0).otherwise(1.0)
        df = df.withColumns(made)
        names += sorted(made)
    return df, names


def scaled(df: DataFrame, columns: list[str], scaler: str = "standard") -> DataFrame:
    """``df`` with the columns' nulls as medians and then scaled; a column without values is 0, one without spread is 0."""
    if scaler not in SCALERS:
        raise ValueError(f"scaler must be one of {SCALERS}")
    df = clean(df)
    medians = summary.column_quantiles(df, columns, [0.5])
    middle = {c: medians[c][0.5] if c in medians else 0.0 for c in columns}
    df = df.withColumns({c: F.coalesce(number(c), F.lit(middle[c])) for c in columns})
    if scaler == "standard":
        one = df.agg(*(x for i, c in enumerate(columns) for x in (F.avg(c).alias(f"a{i}"), F.stddev_pop(c).alias(f"b{i}")))).first()
        shift = {c: (one[f"a{i}"], one[f"b{i}"]) for i, c in enumerate(columns)}
    elif scaler == "robust":
        quartiles = summary.column_quantiles(df, columns, [0.25, 0.5, 0.75])
        shift = {c: (quartiles[c][0.5], quartiles[c][0.75] - quartiles[c][0.25]) if c in quartiles else (0.0, 1.0) for c in columns}
    else:
        one = df.agg(*(x for i, c in enumerate(columns) for x in (F.min(c).alias(f"a{i}"), F.max(c).alias(f"b{i}")))).first()
        shift = {c: (one[f"a{i}"], (one[f"b{i}"] or 0.0) - (one[f"a{i}"] or 0.0)) for i, c in enumerate(columns)}
    return df.withColumns({c: (F.col(c) - F.lit(a or 0.0)) / F.lit(b or 1.0) for c, (a, b) in shift.items()})


@dataclass
class Prepared:
    """Rows with a vector column ``features`` (and ``scaled``, before any reduction), and the names of its parts."""

    rows: DataFrame
    names: list[str]
    explained: list[float]


def prepare(df: DataFrame, columns: list[str] | None = None, categorical: list[str] = (), scaler: str = "standard", variance: float | None = None) -> Prepared:
    """Codes, medians, scaling, and with ``variance`` the first principal components that explain this share of it (of more than two columns)."""
    columns = list(columns if columns is not None else numeric_columns(df))
    need(df, *columns, numeric=True)
    rows, coded = encoded(df, list(categorical))
    names = columns + coded
    if not names:
        raise ValueError("no columns to prepare")
    if variance is not None and not 0 < variance < 1:
        raise ValueError("variance must lie between 0 and 1")
    hidden = {c: f"__f{i}" for i, c in enumerate(names)}
    rows = scaled(rows.withColumns({h: number(c) for c, h in hidden.items()}), list(hidden.values()), scaler)
    rows = VectorAssembler(inputCols=list(hidden.values()), outputCol="scaled").transform(rows).drop(*hidden.values(), *coded)
    explained: list[float] = []
    if variance is not None and len(names) > 2:
        mean, axes, explained = principal(rows)
        k, total = len(names), 0.0
        for i, share in enumerate(explained, 1):
            total += share
            if total >= variance:
                k = i
                break
        rows = projected(rows, mean, axes[:k], "features")
    else:
        rows = rows.withColumn("features", F.col("scaled"))
    return Prepared(rows, names, explained[:])


def principal(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Mean, axes (a row each, the largest loading positive) and shares of variance of the principal components of ``scaled``.

    Every partition sums its rows, their count and their products; the driver only sees these sums, whose size depends on the features alone.
    """

    def sums(batches):
        total = None
        for pdf in batches:
            if len(pdf):
                x = np.column_stack([np.ones(len(pdf)), np.stack(pdf["x"].to_numpy())])
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pd.DataFrame({"i": np.arange(total.size), "v": total.ravel()})

    found = rows.select(vector_to_array("scaled").alias("x")).mapInPandas(sums, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toPandas()["v"].to_numpy()
    d = round(len(found) ** 0.5)
    found = found.reshape(d, d)
    n, mean = max(found[0, 0], 1.0) if d else 1.0, found[0, 1:] / max(found[0, 0], 1.0)
    spread, axes = np.linalg.eigh((found[1:, 1:] - n * np.outer(mean, mean)) / max(n - 1, 1))
    spread, axes = np.maximum(spread[::-1], 0), axes.T[::-1]
    axes = axes * np.where(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
    return mean, axes, (spread / (spread.sum() or 1.0)).tolist()


def projected(rows: DataFrame, mean: np.ndarray, axes: np.ndarray, output: str) -> DataFrame:
    """``scaled`` on the axes, as the vector column ``output``."""
    x = vector_to_array("scaled")
    parts = [F.aggregate(F.zip_with(x, F.lit([float(v) for v in axis]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) - float(mean @ axis) for axis in axes]
    return rows.withColumn(output, array_to_vector(F.array(*parts)))


def reduced(rows: DataFrame, k: int) -> DataFrame:
    """``rows`` with the first ``k`` principal components of ``scaled`` as ``features``."""
    mean, axes, _ = principal(rows)
    return projected(rows, mean, axes[:k], "features")


def projection_2d(rows: DataFrame) -> DataFrame:
    """``rows`` with ``pc_1`` and ``pc_2`` of the scaled features; needs two of them."""
    mean, axes, _ = principal(rows)
    xy = vector_to_array("__xy")
    return projected(rows, mean, axes[:2], "__xy").withColumns({"pc_1": xy[0], "pc_2": xy[1]}).drop("__xy")


def from_array(df: DataFrame, column: str) -> DataFrame:
    """Rows whose array column becomes ``features`` and ``scaled``; a null stays null."""
    vector = F.when(F.col(column).isNotNull(), array_to_vector(F.col(column).cast("array<double>")))
    return df.withColumns({"features": vector, "scaled": vector})
