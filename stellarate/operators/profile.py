"""Table profiles: counts, nulls, duplicates and summary statistics.

Everything that one aggregate can hold is computed in one pass over the table.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stellarate.functions.numbers import (
    is_floating,
    is_missing,
    known,
    numeric_columns,
)
from stellarate.operators.ordered import ValueCounts

QUARTILES = {"25%": 0.25, "50%": 0.5, "75%": 0.75}
TABLE = "(table)"


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"))


def null_counts(df: DataFrame, columns: Sequence[str] = (), nan_as_null: bool = False) -> DataFrame:
    """One row with the number of nulls of each column."""
    return df.agg(
        *[F.count_if(is_missing(df, c, nan_as_null)).alias(c) for c in columns or df.columns]
    )


def nonnull_counts(df: DataFrame, columns: Sequence[str] = (), nan_as_null: bool = False) -> DataFrame:
    """One row with the number of set values of each column."""
    return df.agg(
        *[F.count_if(~is_missing(df, c, nan_as_null)).alias(c) for c in columns or df.columns]
    )


def null_columns(df: DataFrame, nan_as_null: bool = False) -> DataFrame:
    """The columns that hold nulls, with the number of them."""
    counts = null_counts(df, nan_as_null=nan_as_null)
    return counts.unpivot([], counts.columns, "column", "nulls").where("nulls > 0")


def any_missing(df: DataFrame, nan_as_null: bool = False) -> Column:
    return reduce(
        lambda left, right: left | right,
        [is_missing(df, c, nan_as_null) for c in df.columns],
    )


def null_rows(df: DataFrame, nan_as_null: bool = False) -> DataFrame:
    """The number of rows with at least one null."""
    return df.agg(F.count_if(any_missing(df, nan_as_null)).alias("null_rows"))


def row_digest(df: DataFrame) -> Column:
    """SHA-256 of the whole row, nested columns included.

    Rows are compared by these 32 bytes, so that long texts are not shuffled.
    """
    columns = [
        exact(F.col(f"`{field.name}`"), field.dataType).alias(field.name) for field in df.schema
    ]
    text = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return F.unhex(F.sha2(text, 256))


def exact(column: Column, kind: T.DataType) -> Column:
    """``column`` such that its JSON tells apart all values that differ, and no others.

    JSON cuts timestamps to milliseconds, so they go as microseconds; -0.0 goes as
    0.0; binaries as base64; the entries of a map are sorted by key.
    """
    if is_floating(kind):
        return column + F.lit(0.0)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column)
    if isinstance(kind, T.TimestampNTZType):
        return column.cast("string")
    if isinstance(kind, T.BinaryType):
        return F.base64(column)
    if isinstance(kind, T.StructType):
        fields = [exact(column.getField(f.name), f.dataType).alias(f.name) for f in kind]
        return F.when(column.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda item: exact(item, kind.elementType))
    if isinstance(kind, T.MapType):
        entries = F.transform(
            F.map_entries(column),
            lambda entry: F.struct(
                exact(entry["key"], kind.keyType).alias("key"),
                exact(entry["value"], kind.valueType).alias("value"),
            ),
        )
        return F.array_sort(
            entries,
            lambda a, b: F.when(F.to_json(a) < F.to_json(b), -1)
            .when(F.to_json(a) > F.to_json(b), 1)
            .otherwise(0),
        )
    return column


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each set of equal rows."""
    copies = df.groupBy(row_digest(df).alias("digest")).agg(F.count(F.lit(1)).alias("n"))
    return copies.agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows")
    )


def _statistic(
    df: DataFrame, name: str, stat: str, shares: list[float]
) -> tuple[Column, Column]:
    """(numeric value, text value) of one statistic as aggregate columns.

    The approximate quantiles of a column are all taken from one sketch.
    """
    kind = df.schema[name].dataType
    column = F.col(f"`{name}`")
    no_number, no_text = F.lit(None).cast("double"), F.lit(None).cast("string")
    if stat == "count":
        return F.count(known(df, name) if is_floating(kind) else column).cast("double"), no_text
    extremes = {"min": F.min, "max": F.max}
    if not isinstance(kind, T.NumericType):
        return no_number, extremes[stat](column).cast("string") if stat in extremes else no_text
    number = known(df, name)
    if stat in extremes:
        if isinstance(kind, (T.LongType, T.DecimalType)):
            # a double cannot hold all of them; the text is exact
            value = extremes[stat](column)
            return value.cast("double"), value.cast("string")
        return extremes[stat](number), no_text
    if stat == "mean":
        return F.avg(number), no_text
    if stat in ("std", "stddev"):
        return F.stddev_samp(number), no_text
    sketch = F.percentile_approx(number, shares, 10_000)
    return sketch[shares.index(_share(stat))], no_text


def _share(stat: str) -> float:
    return float(stat.rstrip("%")) / 100


def _cells(df: DataFrame, columns: Sequence[str], stats: Sequence[str]) -> list[Column]:
    shares = [_share(stat) for stat in stats if stat.endswith("%")]
    return [
        F.struct(
            F.lit(name).alias("column"),
            F.lit(stat).alias("stat"),
            number.alias("value"),
            text.alias("text"),
        )
        for name in columns
        for stat in stats
        for number, text in [_statistic(df, name, stat, shares)]
    ]


def summary(df: DataFrame, columns: Sequence[str], stats: Sequence[str]) -> DataFrame:
    """Long table (column, stat, value, text) of chosen statistics, in one pass.

    Strings have count, min and max (in ``text``); their other statistics are
    null. Extremes of long and decimal columns stand in ``text`` as well, exactly. A statistic like ``25%`` is an approximate quantile.
    """
    cells = _cells(df, columns, stats)
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def described_columns(df: DataFrame) -> list[str]:
    kinds = (T.NumericType, T.StringType)
    return [f.name for f in df.schema if isinstance(f.dataType, kinds)]


def describe_all(df: DataFrame) -> DataFrame:
    """Count, mean, stddev, min and max of all numeric and string columns."""
    return summary(df, described_columns(df), ["count", "mean", "stddev", "min", "max"])


def summary_all(df: DataFrame) -> DataFrame:
    """``describe_all`` with approximate quartiles."""
    stats = ["count", "mean", "stddev", "min", *QUARTILES, "max"]
    return summary(df, described_columns(df), stats)


BASIC = ["count", "mean", "std", "min", "max"]


def quartile_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, stat, value): the exact quartiles; null for a column without values."""
    wide = ValueCounts(df, columns).quantiles(list(QUARTILES.values()))
    labelled = wide.select("column", *[F.col(f"q{i}").alias(q) for i, q in enumerate(QUARTILES)])
    empty = [
        F.struct(
            F.lit(name).alias("column"),
            F.lit(stat).alias("stat"),
            F.lit(None).cast("double").alias("value"),
        )
        for name in columns
        for stat in QUARTILES
    ]
    every = df.sparkSession.range(1, numPartitions=1).select(F.inline(F.array(*empty)))
    found = labelled.unpivot(["column"], list(QUARTILES), "stat", "value")
    return every.unionByName(found).groupBy("column", "stat").agg(F.max("value").alias("value"))


def describe_numeric(df: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """Long table (column, stat, value): count, mean, std, min, exact quartiles, max."""
    names = list(columns) or numeric_columns(df)
    return summary(df, names, BASIC).drop("text").unionByName(quartile_rows(df, names))


def value_range(df: DataFrame, column: str) -> DataFrame:
    """Smallest and largest value; strings compare as strings."""
    return df.agg(F.min(column).alias("oldest"), F.max(column).alias("newest"))


def profile(
    df: DataFrame, name: str, duplicates: bool = True, nan_as_null: bool = True
) -> DataFrame:
    """The whole profile of a table, long: (source, column, stat, value, text).

    Per column: type, non-null count, null count and, for numeric columns, the
    statistics of ``describe_numeric``. For the table: rows, rows with nulls and,
    unless ``duplicates`` is off, duplicate rows.
    """
    def cell(column: str, stat: str, value: Column, text: str | None = None) -> Column:
        return F.struct(
            F.lit(column).alias("column"),
            F.lit(stat).alias("stat"),
            value.cast("double").alias("value"),
            F.lit(text).cast("string").alias("text"),
        )

    cells = [
        cell(TABLE, "rows", F.count(F.lit(1))),
        cell(TABLE, "null_rows", F.count_if(any_missing(df, nan_as_null))),
    ]
    for field in df.schema:
        missing = is_missing(df, field.name, nan_as_null)
        cells += [
            cell(field.name, "type", F.lit(None), field.dataType.simpleString()),
            cell(field.name, "non_null", F.count_if(~missing)),
            cell(field.name, "nulls", F.count_if(missing)),
        ]
    numbers = numeric_columns(df)
    cells += _cells(df, numbers, BASIC)
    parts = [df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))]
    no_text = F.lit(None).cast("string").alias("text")
    if numbers:
        parts.append(quartile_rows(df, numbers).select("*", no_text))
    if duplicates:
        count = duplicate_rows(df).select(F.col("duplicate_rows").cast("double").alias("value"))
        parts.append(
            count.select(
                F.lit(TABLE).alias("column"), F.lit("duplicate_rows").alias("stat"), "value", no_text
            )
        )
    whole = reduce(DataFrame.unionByName, parts)
    return whole.select(F.lit(name).alias("source"), "column", "stat", "value", "text")
