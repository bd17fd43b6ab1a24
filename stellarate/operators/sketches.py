"""Quantile sketches as columns: made per part of a table, kept, and merged without a rescan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stellarate.operators.ordered import stacked
from stellarate.operators.profile import QUARTILES

#: Size parameter of a sketch; 800 takes some 10 KB and keeps ranks within a third of a percent.
SIZE = 800


def rank_error(size: int = SIZE) -> float:
    """Normalised rank error of one quantile that is kept with 99 % confidence.

    Fixed values: the constants published with the KLL sketch for single-sided errors.
    """
    return 2.296 / size**0.9723


def quantile_sketches(
    df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), size: int = SIZE
) -> DataFrame:
    """(by..., column, n, lo, hi, sketch) of the known values of numeric columns.

    One pass for all columns; each task sketches its own rows, so what is shuffled is a
    sketch per task, group and column. Columns without known values have no row.
    """
    long = stacked(df, columns, by)
    return long.groupBy(*by, "column").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("value").alias("lo"),
        F.max("value").alias("hi"),
        F.kll_sketch_agg_double("value", F.lit(size)).alias("sketch"),
    )


def merged_sketches(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The same columns for coarser groups, from the stored rows of ``quantile_sketches``."""
    return sketches.groupBy(*by, "column").agg(
        F.sum("n").alias("n"),
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
        F.kll_merge_agg_double("sketch").alias("sketch"),
    )


def sketch_quantiles(
    sketches: DataFrame, by: Sequence[str] = (), shares: Mapping[str, float] = QUARTILES
) -> DataFrame:
    """(by..., column, stat, value) of the named shares."""
    found = [
        F.struct(
            F.lit(stat).alias("stat"),
            F.kll_sketch_get_quantile_double("sketch", F.lit(float(share))).alias("value"),
        )
        for stat, share in shares.items()
    ]
    return sketches.select(*by, "column", F.inline(F.array(*found)))


def sketch_rank(sketch: str, value: Column) -> Column:
    """About the share of values up to ``value``."""
    return F.kll_sketch_get_rank_double(sketch, value)


def rank_errors(
    quantiles: DataFrame, df: DataFrame, by: Sequence[str] = (), shares: Mapping[str, float] = QUARTILES
) -> DataFrame:
    """(by..., column, stat, error): how far each quantile is from its rank among the rows of ``df``.

    0 if a value equal to the quantile has the wanted rank. One pass over the rows, joined
    with the few quantiles of their group.
    """
    names = [row.column for row in quantiles.select("column").distinct().collect()]
    wanted = quantiles.groupBy(*by, "column").agg(
        F.collect_list(F.struct("stat", "value")).alias("asked")
    )
    # a row of the table for each group and column, like the sketches themselves
    asked = stacked(df, sorted(names), by).join(F.broadcast(wanted), [*by, "column"])
    each = asked.select(*by, "column", F.col("value").alias("x"), F.inline("asked"))
    ranks = each.groupBy(*by, "column", "stat").agg(
        F.avg((F.col("x") < F.col("value")).cast("int")).alias("below"),
        F.avg((F.col("x") <= F.col("value")).cast("int")).alias("upto"),
    )
    share = F.lit(None).cast("double")
    for stat, of in shares.items():
        share = F.when(F.col("stat") == stat, F.lit(float(of))).otherwise(share)
    error = F.greatest(F.lit(0.0), F.col("below") - share, share - F.col("upto"))
    return ranks.select(*by, "column", "stat", error.alias("error"))
