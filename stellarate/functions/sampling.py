"""Reproducible draws from a digest of the row's key.

A row's draw depends on its key and the seed alone, so it is the same under any
partitioning, on any retry and in any engine that has md5. A row with a null in its
key is drawn by the digest of all its columns instead, so such rows are spread like
others.
"""

from __future__ import annotations

from functools import reduce
from itertools import accumulate
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_RANGE = 1 << 32


def draw(keys: list[str], seed: int, row: list[str] | None = None) -> Column:
    """First 32 bits of the key's digest as eight lower-case hex digits.

    ``row`` names the columns (by default the keys) that stand in for a key with nulls.
    """
    parts = [F.col(f"`{key}`").cast("string") for key in keys]
    named = F.concat_ws("|", *parts, F.lit(str(seed)))
    whole = F.to_json(
        F.struct(*[F.col(f"`{name}`") for name in row or keys]), {"ignoreNullFields": "false"}
    )
    unnamed = F.concat_ws("|", F.lit("null"), whole, F.lit(str(seed)))
    has_null = reduce(or_, [part.isNull() for part in parts])
    return F.substring(F.md5(F.when(has_null, unnamed).otherwise(named)), 1, 8)


def threshold(share: float) -> str:
    """Hex digits below which a share of all draws lies."""
    return f"{round(share * _RANGE):08x}"


def below(
    keys: list[str], share: float, seed: int, row: list[str] | None = None
) -> Column:
    if share >= 1.0:
        return F.lit(True)
    return draw(keys, seed, row) < threshold(share)


def hash_sample(df: DataFrame, keys: list[str], fraction: float, seed: int) -> DataFrame:
    """About ``fraction`` of the rows, the same ones every time."""
    return df.where(below(keys, fraction, seed, df.columns))


def split_number(
    keys: list[str], weights: list[float], seed: int, row: list[str] | None = None
) -> Column:
    """Index of the part a row belongs to; parts are disjoint and cover all rows."""
    total = sum(weights)
    bounds = [threshold(mark / total) for mark in accumulate(weights[:-1])]
    digits = draw(keys, seed, row)
    part = F.lit(0)
    for bound in bounds:
        part = part + (digits >= bound).cast("int")
    return part


def hash_split(
    df: DataFrame, keys: list[str], weights: list[float], seed: int
) -> list[DataFrame]:
    part = split_number(keys, weights, seed, df.columns)
    return [df.where(part == number) for number in range(len(weights))]


def fold_number(
    keys: list[str], folds: int, seed: int, row: list[str] | None = None
) -> Column:
    """Fold 0..folds-1 for cross-validation, independent of the split's draw."""
    return split_number(keys, [1.0] * folds, seed, row)


def bernoulli_sample(df: DataFrame, fraction: float, seed: int | None = None) -> DataFrame:
    """Spark's own sample without replacement; changes with the partitioning."""
    return df.sample(False, fraction, seed)
