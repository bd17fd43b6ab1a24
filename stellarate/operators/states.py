"""Profiles from states that are kept per landed file and put together without a rescan.

A file is read once, when it lands. What is kept of it are counts, extremes and moments per
column, co-moments per pair of columns, and, for what moments cannot tell, the file's distinct
numbers and row digests with their counts. States of any files add up to the profile
of the rows of all of them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stellarate.functions.numbers import is_missing, known, numeric_columns
from stellarate.operators.ordered import ValueCounts, stacked
from stellarate.operators.profile import QUARTILES, TABLE, any_missing, row_digest

#: Exact extremes: all of a long's digits, and up to 18 decimals of a decimal.
EXACT = "decimal(38,18)"
PARTS = ("columns", "pairs", "values", "digests")


@dataclass(frozen=True)
class States:
    """Four tables, each with a column ``file``.

    ``columns``: (column, type, rows, null_rows, nulls, non_null, n, mean, m2, lo, hi, lo_exact, hi_exact);
    ``pairs``: (x, y, n, mean_x, mean_y, m2_x, m2_y, c); ``values``: (column, value, n);
    ``digests``: (digest, n).
    """

    columns: DataFrame
    pairs: DataFrame
    values: DataFrame | None = None
    digests: DataFrame | None = None


def _spread(value: Column) -> Column:
    """Sum of squared distances from the mean."""
    return F.coalesce(F.var_pop(value), F.lit(0.0)) * F.count(value)


def column_states(df: DataFrame, file: str, nan_as_null: bool = True) -> DataFrame:
    """One row per file and column, in one aggregate over the rows."""
    data = [f for f in df.schema if f.name != file]
    rows = df.drop(file)
    cells = []
    for field in data:
        missing = is_missing(df, field.name, nan_as_null)
        number = isinstance(field.dataType, T.NumericType)
        value = known(df, field.name) if number else F.lit(None).cast("double")
        whole = isinstance(field.dataType, (T.LongType, T.DecimalType))
        exact = F.col(f"`{field.name}`").cast(EXACT) if whole else F.lit(None).cast(EXACT)
        cells.append(
            F.struct(
                F.lit(field.name).alias("column"),
                F.lit(field.dataType.simpleString()).alias("type"),
                F.count(F.lit(1)).alias("rows"),
                F.count_if(any_missing(rows, nan_as_null)).alias("null_rows"),
                F.count_if(missing).alias("nulls"),
                F.count_if(~missing).alias("non_null"),
                F.count(value).alias("n"),
                F.avg(value).alias("mean"),
                _spread(value).alias("m2"),
                F.min(value).alias("lo"),
                F.max(value).alias("hi"),
                F.min(exact).alias("lo_exact"),
                F.max(exact).alias("hi_exact"),
            )
        )
    by_file = df.groupBy(F.col(f"`{file}`").alias("file"))
    return by_file.agg(F.array(*cells).alias("cells")).select("file", F.inline("cells"))


def pair_states(df: DataFrame, file: str, columns: Sequence[str]) -> DataFrame:
    """One row per file and pair of numeric columns, over the rows in which both are known."""
    cells = []
    for a, b in combinations(columns, 2):
        both = known(df, a).isNotNull() & known(df, b).isNotNull()
        x, y = F.when(both, known(df, a)), F.when(both, known(df, b))
        cells.append(
            F.struct(
                F.lit(a).alias("x"),
                F.lit(b).alias("y"),
                F.count(x).alias("n"),
                F.avg(x).alias("mean_x"),
                F.avg(y).alias("mean_y"),
                _spread(x).alias("m2_x"),
                _spread(y).alias("m2_y"),
                (F.coalesce(F.covar_pop(x, y), F.lit(0.0)) * F.count(x)).alias("c"),
            )
        )
    kind = (
        "array<struct<x string, y string, n bigint, mean_x double, mean_y double, "
        "m2_x double, m2_y double, c double>>"
    )
    held = F.array(*cells) if cells else F.array().cast(kind)
    by_file = df.groupBy(F.col(f"`{file}`").alias("file"))
    return by_file.agg(held.alias("cells")).select("file", F.inline("cells"))


def file_states(df: DataFrame, file: str, nan_as_null: bool = True) -> States:
    """The states of the rows of ``df``, per value of the column ``file``, which is not profiled."""
    numbers = [name for name in numeric_columns(df) if name != file]
    named = df.withColumnRenamed(file, "_file")
    if numbers:
        long = stacked(named, numbers, ["_file"])
        values = long.groupBy("_file", "column", "value").agg(F.count(F.lit(1)).alias("n"))
    else:
        empty = named.where(F.lit(False))
        values = empty.select(
            "_file", F.lit("").alias("column"), F.lit(0.0).alias("value"), F.lit(0).cast("bigint").alias("n")
        )
    digest = row_digest(df.drop(file))
    digests = df.select(F.col(f"`{file}`").alias("file"), digest.alias("digest"))
    return States(
        column_states(df, file, nan_as_null),
        pair_states(df, file, numbers),
        values.withColumnRenamed("_file", "file"),
        digests.groupBy("file", "digest").agg(F.count(F.lit(1)).alias("n")),
    )


def add_states(states: States, path: str, parts: Sequence[str] = PARTS) -> None:
    """Append states to those kept under ``path``; of some tables only, if only they are wanted."""
    for part in parts:
        getattr(states, part).write.mode("append").parquet(f"{path.rstrip('/')}/{part}")


def kept_states(spark: SparkSession, path: str, parts: Sequence[str] = PARTS) -> States:
    return States(**{part: spark.read.parquet(f"{path.rstrip('/')}/{part}") for part in parts})


def _shifted(n: str, mean: str, whole: str) -> Column:
    """What a part's distance from the whole's mean adds to the squares."""
    away = F.col(mean) - F.col(whole)
    return F.coalesce(F.col(n) * away * away, F.lit(0.0))


def _with_whole(states: DataFrame, keys: Sequence[str], means: dict[str, str]) -> DataFrame:
    """The states with the mean over all files, {mean: its name}, of their key.

    Means are added up as distances from the smallest one, so that values far from 0 keep
    their digits. Both sides of the joins have a row per key: a column or a pair of columns.
    """
    some = states.where("n > 0")
    base = some.groupBy(*keys).agg(*[F.min(m).alias(f"base_{w}") for m, w in means.items()])
    away = [
        (F.first(f"base_{w}") + F.sum(F.col("n") * (F.col(m) - F.col(f"base_{w}"))) / F.sum("n")).alias(w)
        for m, w in means.items()
    ]
    whole = some.join(F.broadcast(base), list(keys)).groupBy(*keys).agg(*away)
    return states.join(F.broadcast(whole), list(keys), "left")


def merged_columns(columns: DataFrame) -> DataFrame:
    """The rows of ``column_states`` over all files, without ``file``."""
    joined = _with_whole(columns, ["column"], {"mean": "whole"})
    return joined.groupBy("column", "type").agg(
        *[F.sum(c).alias(c) for c in ("rows", "null_rows", "nulls", "non_null", "n")],
        F.max("whole").alias("mean"),
        F.sum(F.col("m2") + _shifted("n", "mean", "whole")).alias("m2"),
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
        F.min("lo_exact").alias("lo_exact"),
        F.max("hi_exact").alias("hi_exact"),
    )


def merged_pairs(pairs: DataFrame) -> DataFrame:
    """The rows of ``pair_states`` over all files, without ``file``."""
    joined = _with_whole(pairs, ["x", "y"], {"mean_x": "whole_x", "mean_y": "whole_y"})
    across = F.col("n") * (F.col("mean_x") - F.col("whole_x")) * (F.col("mean_y") - F.col("whole_y"))
    return joined.groupBy("x", "y").agg(
        F.sum("n").alias("n"),
        F.max("whole_x").alias("mean_x"),
        F.max("whole_y").alias("mean_y"),
        F.sum(F.col("m2_x") + _shifted("n", "mean_x", "whole_x")).alias("m2_x"),
        F.sum(F.col("m2_y") + _shifted("n", "mean_y", "whole_y")).alias("m2_y"),
        F.sum(F.col("c") + F.coalesce(across, F.lit(0.0))).alias("c"),
    )


def correlation(states: States) -> DataFrame:
    """(x, y, r) of all pairs of numeric columns, both ways; null where one does not vary."""
    spread = F.sqrt(F.col("m2_x")) * F.sqrt(F.col("m2_y"))
    found = merged_pairs(states.pairs).select("x", "y", F.try_divide("c", spread).alias("r"))
    own = merged_columns(states.columns).where("n > 0").select(
        F.col("column").alias("x"), F.col("column").alias("y"), F.when(F.col("m2") > 0, 1.0).alias("r")
    )
    return found.unionByName(found.select(F.col("y").alias("x"), F.col("x").alias("y"), "r")).unionByName(own)


def merged_profile(states: States, name: str, duplicates: bool = True) -> DataFrame:
    """``profile`` of the rows of all files: (source, column, stat, value, text).

    Quartiles are exact: they come from the counted values, of which every file gives each once.
    """

    def cell(column: Column, stat: str, value: Column, text: Column | None = None) -> Column:
        return F.struct(
            column.alias("column"),
            F.lit(stat).alias("stat"),
            value.cast("double").alias("value"),
            (F.lit(None) if text is None else text).cast("string").alias("text"),
        )

    def written(end: str) -> Column:
        # all of EXACT's decimals, cut to those of the column's type
        text, scale = F.col(end).cast("string"), F.regexp_extract("type", r",(\d+)\)", 1)
        digits = F.when(scale == "", 0).otherwise(F.try_to_number(scale, F.lit("99")).cast("int"))
        point = F.when(digits == 0, 1).otherwise(0)
        return F.substring(text, F.lit(1), F.length(text) - 18 + digits - point)

    merged = merged_columns(states.columns)
    named = F.col("column")
    number = F.col("type").isin("tinyint", "smallint", "int", "bigint", "float", "double") | F.col(
        "type"
    ).startswith("decimal")
    always = [
        cell(named, "type", F.lit(None), F.col("type")),
        cell(named, "non_null", F.col("non_null")),
        cell(named, "nulls", F.col("nulls")),
    ]
    spread = F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1)))
    measured = [
        cell(named, "count", F.col("n")),
        cell(named, "mean", F.col("mean")),
        cell(named, "std", spread),
        cell(named, "min", F.col("lo"), written("lo_exact")),
        cell(named, "max", F.col("hi"), written("hi_exact")),
    ]
    cells = F.array(*always)
    parts = [merged.select(F.inline(F.when(number, F.concat(cells, F.array(*measured))).otherwise(cells)))]
    # every column's state counts the same rows
    rows = merged.agg(F.max("rows").alias("rows"), F.max("null_rows").alias("null_rows"))
    table = [cell(F.lit(TABLE), s, F.coalesce(F.col(s), F.lit(0))) for s in ("rows", "null_rows")]
    parts.append(rows.select(F.inline(F.array(*table))))
    found = ValueCounts.counted(states.values).quantiles(list(QUARTILES.values()))
    labelled = found.select("column", *[F.col(f"q{i}").alias(q) for i, q in enumerate(QUARTILES)])
    wide = merged.where(number).select("column").join(labelled, "column", "left")
    no_text = F.lit(None).cast("string").alias("text")
    parts.append(wide.unpivot(["column"], list(QUARTILES), "stat", "value").select("*", no_text))
    if duplicates:
        copies = states.digests.groupBy("digest").agg(F.sum("n").alias("n"))
        count = copies.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("double").alias("value"))
        parts.append(
            count.select(
                F.lit(TABLE).alias("column"), F.lit("duplicate_rows").alias("stat"), "value", no_text
            )
        )
    whole = reduce(DataFrame.unionByName, parts)
    return whole.select(F.lit(name).alias("source"), "column", "stat", "value", "text")
