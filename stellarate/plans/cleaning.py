"""Cleaning job: landing JSON lines -> cleaned Parquet, one table at a time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stellarate.operators.columns import drop_columns, drop_incomplete_rows
from stellarate.operators.profile import null_counts
from stellarate.session import scratch_path
from stellarate.sources.schemas import SCHEMAS
from stellarate.sources.bucketed import Bucketed, bucket_count, write_bucketed
from stellarate.sources.tables import Layout, read_parquet, stored, write_parquet
from stellarate.sources.variants import variant_lines


@dataclass(frozen=True)
class Rule:
    """``drop`` names columns that go; ``keep``, where set, all columns that stay."""

    drop: tuple[str, ...] = ()
    keep: tuple[str, ...] = ()
    complete_rows_only: bool = False


RULES: dict[str, Rule] = {
    "business": Rule(drop=("hours",), complete_rows_only=True),
    "checkin": Rule(),
    "review": Rule(),
    "tip": Rule(drop=("compliment_count",)),
    "user": Rule(
        keep=("average_stars", "review_count", "useful", "user_id", "yelping_since")
    ),
}


def clean(df: DataFrame, rule: Rule) -> DataFrame:
    kept = drop_columns(df, *rule.drop)
    if rule.keep:
        kept = kept.select(*rule.keep)
    return drop_incomplete_rows(kept) if rule.complete_rows_only else kept


def landing_lines(
    spark: SparkSession, layout: Layout, table: str
) -> tuple[DataFrame, DataFrame]:
    """(rows with every column and nested field, rejected lines) of a raw table."""
    parsed = scratch_path(spark, f"{table}-variants")
    return variant_lines(spark, layout.landing(table), SCHEMAS[table], parsed)


def landing_table(spark: SparkSession, layout: Layout, table: str) -> DataFrame:
    """The raw table with every column and nested field."""
    return landing_lines(spark, layout, table)[0]


def typed_dates(df: DataFrame, *columns: str) -> DataFrame:
    """Date-time strings as timestamps; what is no date-time becomes null."""
    return df.withColumns({c: F.try_to_timestamp(F.col(c)) for c in columns})


def clean_table(
    spark: SparkSession, layout: Layout, table: str, mode: str = "errorifexists"
) -> DataFrame:
    """Clean one table and write it; returns the written table.

    Lines that could not be read are written to ``layout.rejected(table)``, also if
    there are none.
    """
    rows, rejects = landing_lines(spark, layout, table)
    write_parquet(rejects, layout.rejected(table), mode)
    return stored(clean(rows, RULES[table]), layout.cleaned(table), mode)


def bucket_cleaned(
    spark: SparkSession, layout: Layout, table: str, key: str = "business_id", buckets: int | None = None
) -> Bucketed:
    """The cleaned table once more, in buckets by ``key``, for joins that move no rows."""
    rows = read_parquet(spark, layout.cleaned(table))
    return write_bucketed(rows, layout.bucketed(table), key, buckets or bucket_count(rows.count()))


def null_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """(column, before, after): nulls per column; dropped columns have no ``after``."""
    sides = [
        counts.unpivot([], counts.columns, "column", side)
        for side, counts in (("before", null_counts(before)), ("after", null_counts(after)))
    ]
    return sides[0].join(sides[1], "column", "left")
