"""Column-level preparation: renames, lifted nested fields, drops, null removal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stellarate.functions.numbers import is_floating


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def lift_fields(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Add nested fields as top-level columns: {new name: dotted path}."""
    return df.withColumns({name: F.col(path) for name, path in fields.items()})


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    """Drop what is there; names the frame lacks are ignored."""
    return df.drop(*names)


def drop_incomplete_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows whose columns are all set; NaN in a floating column counts as unset.

    Same rows as ``na.drop("any")``, but written as separate conjuncts, which
    the Parquet scan accepts as pushed filters.
    """
    kept = df
    for name in columns or df.columns:
        kept = kept.where(F.col(f"`{name}`").isNotNull())
        if is_floating(df.schema[name].dataType):
            kept = kept.where(~F.isnan(F.col(f"`{name}`")))
    return kept


def schema_profile(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type, nullability."""
    rows = [
        (position, field.name, field.dataType.simpleString(), field.nullable)
        for position, field in enumerate(df.schema)
    ]
    return df.sparkSession.createDataFrame(
        rows, "position int, column string, type string, nullable boolean"
    )
