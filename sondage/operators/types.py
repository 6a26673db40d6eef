"""Column kinds and null normalisation shared by all analyses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class UnknownColumn(ValueError):
    """A column that the data doesn't have."""


class WrongKind(ValueError):
    """A column of a kind that the analysis doesn't take."""


def is_number(kind: T.DataType) -> bool:
    """Kinds that count as numeric columns; booleans don't."""
    return isinstance(kind, T.NumericType)


def is_stat_numeric(kind: T.DataType) -> bool:
    """Kinds that have numeric statistics; booleans do, as 0 and 1."""
    return isinstance(kind, (T.NumericType, T.BooleanType))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_number(f.dataType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def scalar_columns(df: DataFrame) -> list[str]:
    """All but nested columns."""
    return [f.name for f in df.schema if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]


def nested_keys(df: DataFrame) -> list[Column]:
    """What tells the values of nested columns apart; maps, which can't be compared, as their sorted entries."""
    nested = [f for f in df.schema if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]
    return [F.array_sort(F.map_entries(f.name)).alias(f"__{f.name}") if isinstance(f.dataType, T.MapType) else F.col(f.name) for f in nested]


def need(df: DataFrame, *columns: str, numeric: bool = False) -> None:
    for name in columns:
        if name not in df.columns:
            raise UnknownColumn(name)
        if numeric and not is_number(df.schema[name].dataType):
            raise WrongKind(f"{name} is not numeric")


def clean(df: DataFrame) -> DataFrame:
    """NaN becomes null in floating-point columns, so that there is one notion of missing."""
    floats = {f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return df.withColumns(floats) if floats else df


def number(name: str) -> Column:
    return F.col(name).cast("double")


def stacked(df: DataFrame, columns: list[str], value: str = "value", key: str = "column") -> DataFrame:
    """(column, value) rows of double columns; one pass over the data whatever the number of columns."""
    return df.select(*(number(c).alias(c) for c in columns)).unpivot([], columns, key, value)
