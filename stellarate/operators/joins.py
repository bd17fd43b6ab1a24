"""The N:1 join of a fact table to its dimension."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Measured size, and rows, of a dimension up to which it is broadcast.
BROADCAST_BYTES = 10 << 20
BROADCAST_ROWS = 200_000
HOT_SHARE = 0.001
#: Fact rows of one key that one task should get.
ROWS_PER_PART = 1_000_000


#: The key while sides are joined, whatever its own name (which may hold a dot).
KEY = "_join_key"


def join_dimension(
    fact: DataFrame,
    dimension: DataFrame,
    key: str,
    spread: list[str] | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
    rows_per_part: int = ROWS_PER_PART,
    how: str = "inner",
) -> DataFrame:
    """Join on ``key``, which is unique in ``dimension``; ``how`` is inner or left.

    A dimension of at most ``BROADCAST_ROWS`` rows and ``broadcast_bytes``, which are
    measured first, is broadcast, and then the fact table is read once, by the join. Otherwise
    both sides are shuffled, and keys with more than ``HOT_SHARE`` of the fact rows and more
    than ``rows_per_part`` rows are dealt to as many parts as their rows ask for; the
    dimension's row is repeated for each part. ``spread`` names columns that tell fact rows
    apart: all that can be hashed by default. A left join keeps fact rows with a null key, which
    meet no other rows and are not shuffled.
    """
    left, right = fact.withColumnRenamed(key, KEY), dimension.withColumnRenamed(key, KEY)
    if broadcast_bytes and fits(dimension, broadcast_bytes):
        return left.join(F.broadcast(right), KEY, how).withColumnRenamed(KEY, key)
    hot = F.broadcast(hot_keys(left, KEY, rows_per_part))
    known = left.where(F.col(KEY).isNotNull()) if how == "left" else left
    spread = None if spread is None else [KEY if name == key else name for name in spread]
    joined = dealt(known, hot, KEY, spread).join(repeated(right, hot, KEY), [KEY, "_salt"], how)
    joined = joined.drop("_salt")
    if how == "left":
        joined = joined.unionByName(left.where(F.col(KEY).isNull()), allowMissingColumns=True)
    return joined.withColumnRenamed(KEY, key)


def held_bytes(field: T.StructField) -> Column:
    """About the bytes that a value takes."""
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 8
    if isinstance(field.dataType, (T.StructType, T.ArrayType, T.MapType)):
        return F.octet_length(F.to_json(F.struct(column)))
    return F.lit(16)


def fits(dimension: DataFrame, most_bytes: int) -> bool:
    """Whether a table is small, by its rows and the length of their values."""
    length = reduce(add, [held_bytes(field) for field in dimension.schema])
    seen = dimension.limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)), F.sum(length)).first()
    return seen[0] <= BROADCAST_ROWS and (seen[1] or 0) <= most_bytes


def hot_keys(fact: DataFrame, key: str, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """(key, _parts) of the hot keys: at most 1 / HOT_SHARE rows, found in one pass."""
    counts = fact.groupBy(F.col(f"`{key}`").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    crowded = F.col("key").isNotNull() & (F.col("n") > rows_per_part)
    # at most one key in rows_per_part rows is listed
    listed = F.collect_list(F.when(crowded, F.struct("key", "n")))
    total, found = counts.agg(F.sum("n"), listed).first()
    hot = [
        (row.key, -(-row.n // rows_per_part)) for row in found if row.n > (total or 0) * HOT_SHARE
    ]
    kind = fact.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("_parts", T.IntegerType())])
    return fact.sparkSession.createDataFrame(hot, schema)


def dealt(fact: DataFrame, hot: DataFrame, key: str, spread: list[str] | None = None) -> DataFrame:
    """``fact`` with ``_salt``: the part a row of a hot key goes to, 0 for other keys."""
    columns = spread or [n for n, kind in fact.dtypes if "map<" not in kind and kind != "variant"]
    # a null in one column does not bring rows together as long as others differ
    part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in columns]), F.col("_parts")).cast("int")
    return (
        fact.join(hot, key, "left")
        .withColumn("_salt", F.coalesce(part, F.lit(0)))
        .drop("_parts")
    )


def repeated(dimension: DataFrame, hot: DataFrame, key: str) -> DataFrame:
    """``dimension`` with a row for each part of a hot key."""
    last = F.coalesce("_parts", F.lit(1)) - 1
    return (
        dimension.join(hot, key, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), last)))
        .drop("_parts")
    )
