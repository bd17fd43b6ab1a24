"""Scalar expressions over numeric columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_floating(kind: T.DataType) -> bool:
    return isinstance(kind, (T.DoubleType, T.FloatType))


def is_missing(df: DataFrame, name: str, nan_as_null: bool = False) -> Column:
    """Null test; with ``nan_as_null`` a NaN counts as missing as well."""
    column = F.col(f"`{name}`")
    if nan_as_null and is_floating(df.schema[name].dataType):
        return column.isNull() | F.isnan(column)
    return column.isNull()


def known(df: DataFrame, name: str) -> Column:
    """The column as double, with NaN turned to null."""
    column = F.col(f"`{name}`").cast("double")
    if is_floating(df.schema[name].dataType):
        return F.when(~F.isnan(column), column)
    return column


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def binarize(column: Column, limit: float = 2.999) -> Column:
    """1.0 above ``limit``, else 0.0; null stays null."""
    return (column > F.lit(limit)).cast("double")
