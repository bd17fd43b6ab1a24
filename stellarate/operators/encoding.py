"""Categories to numbers and min-max scaling, as plain DataFrame steps.

What is learned is a table: rows (value, index) of a category, rows (column, lo, hi) of a scale.
It can be stored, and applied to rows that were not there when it was made.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stellarate.functions.numbers import known
from stellarate.operators.distributions import value_counts
from stellarate.operators.joins import join_dimension
from stellarate.operators.ordered import numbered

INVALID = ("error", "skip", "keep")


def category_index(df: DataFrame, column: str, output: str) -> DataFrame:
    """Index table (column, count, output): 0.0 for the most frequent value.

    Equal counts are ordered by value. The numbering is distributed, so the
    number of categories is not limited by one machine.
    """
    counts = value_counts(df.withColumnRenamed(column, "_value"), "_value")
    placed = numbered(counts, F.desc("count"), F.asc("_value"), name=output)
    return placed.withColumn(output, F.col(f"`{output}`").cast("double")).withColumnRenamed("_value", column)


def fit_categories(df: DataFrame, column: str) -> DataFrame:
    """(value, index) of the categories of a column; nulls are none."""
    return category_index(df.select(F.col(f"`{column}`").alias("value")), "value", "index").drop("count")


def apply_categories(
    df: DataFrame,
    fitted: DataFrame,
    column: str,
    output: str,
    handle_invalid: str = "error",
    spread: list[str] | None = None,
) -> DataFrame:
    """Add the index that ``fitted`` (value, index) has for each row's category.

    ``handle_invalid`` is for categories that are null or not in ``fitted``: such rows
    make the job fail where it runs (``error``), are left out (``skip``), or get the index after
    the last one (``keep``). Every row of ``df`` is read once; a category with a large share
    of the rows is dealt to several tasks.
    """
    if handle_invalid not in INVALID:
        raise ValueError(f"handle_invalid: {handle_invalid}")
    table = fitted.select(F.col("value").alias(column), F.col("index").alias(output))
    if handle_invalid == "skip":
        return join_dimension(df, table, column, spread)
    found = join_dimension(df, table, column, spread, how="left")
    index = F.col(f"`{output}`")
    if handle_invalid == "keep":
        beyond = fitted.agg(F.count(F.lit(1)).cast("double").alias("n")).scalar()
        return found.withColumn(output, F.coalesce(index, beyond))
    name = F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("null"))
    failure = F.raise_error(F.concat(F.lit(f"{column} has a category without index: "), name))
    return found.withColumn(output, F.coalesce(index, failure.cast("double")))


def index_categories(
    df: DataFrame,
    column: str,
    output: str,
    spread: list[str] | None = None,
    handle_null: str = "skip",
) -> DataFrame:
    """Add the index of each row's category, learned on the same rows.

    ``handle_null``: rows without a category are left out (``skip``), get the index
    after the last (``keep``) or make the call fail (``error``).
    """
    if handle_null not in INVALID:
        raise ValueError(f"handle_null: {handle_null}")
    if handle_null == "error" and df.where(F.col(f"`{column}`").isNull()).limit(1).count():
        raise ValueError(f"{column} has rows without a category")
    return apply_categories(df, fit_categories(df, column), column, output, handle_null, spread)


def fit_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, lo, hi) of the known values of some numeric columns, in one pass."""
    ends = [
        F.struct(
            F.lit(name).alias("column"), F.min(known(df, name)).alias("lo"), F.max(known(df, name)).alias("hi")
        )
        for name in columns
    ]
    return df.agg(F.array(*ends).alias("ends")).select(F.inline("ends"))


def scaled(x: Column, lo: Column, hi: Column, clip: bool = False) -> Column:
    """``x`` on a scale from 0 at ``lo`` to 1 at ``hi``; 0.5 on a scale of one value."""
    place = F.when(lo == hi, F.when(x.isNotNull(), 0.5)).otherwise((x - lo) / (hi - lo))
    return F.when(place.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), place))) if clip else place


def apply_scale(
    df: DataFrame, fitted: DataFrame, outputs: Mapping[str, str], clip: bool = False
) -> DataFrame:
    """Add scaled columns, {column: output}, by the rows (column, lo, hi) of ``fitted``.

    Values beyond the fitted ends lie outside [0, 1], or on its ends with ``clip``. A
    column of which nothing was known when the scale was fitted is null.
    """
    added = {}
    for name, output in outputs.items():
        ends = fitted.where(F.col("column") == name).select(F.struct("lo", "hi").alias("s")).scalar()
        added[output] = scaled(known(df, name), ends["lo"], ends["hi"], clip)
    return df.withColumns(added)


def min_max(df: DataFrame, column: str, output: str) -> DataFrame:
    """Add the column scaled to [0, 1]; a constant column becomes 0.5."""
    return apply_scale(df, fit_scale(df, [column]), {column: output})
