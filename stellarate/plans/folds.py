"""What the feature stages learn on the training side of every fold, in one pass over the rows.

Fitting the stages anew for each fold reads the frame once per stage and fold. All they learn
are counts and extremes, which can be put together: they are taken per fold, and the
training side of a fold is the sum of all other folds.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stellarate.operators.optimality import entries

ROWS, TERM = "rows", "term"


def fold_sums(
    folded: DataFrame, fold: str, categories: Sequence[str], number: str, terms: str | None = None
) -> DataFrame:
    """(fold, kind, key, n, lo, hi) of each fold's own rows.

    ``kind`` "rows" counts the rows and has the extremes of ``number``; a category's name has the
    rows of each of its values, and "term" the rows in which an entry of the vector ``terms``
    is not 0. Values that are null are left out.
    """
    value = F.col(number).cast("double")

    def counted(kind: str, key: Column, x: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("key"), x.alias("x"))

    nothing = F.lit(None).cast("double")
    seen = [counted(ROWS, F.lit(""), value)]
    seen += [counted(name, F.col(f"`{name}`"), nothing) for name in categories]
    found = F.array(*seen)
    if terms:
        held = F.filter(entries(terms), lambda e: e["x"] != 0)
        found = F.concat(found, F.transform(held, lambda e: counted(TERM, e["idx"], nothing)))
    rows = folded.select(F.col(fold).alias("fold"), F.explode(found).alias("e"))
    return rows.where("e.key is not null").groupBy("fold", "e.kind", "e.key").agg(
        F.count(F.lit(1)).alias("n"), F.min("e.x").alias("lo"), F.max("e.x").alias("hi")
    )


def training_sums(sums: DataFrame, folds: int) -> DataFrame:
    """The same columns for the training side of each fold: all folds but its own."""
    others = F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: f != F.col("fold"))
    sides = sums.select(F.explode(others).alias("fold"), "kind", "key", "n", "lo", "hi")
    return sides.groupBy("fold", "kind", "key").agg(
        F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
    )


@dataclass
class Side:
    """What stages fitted on the training side of one fold would know."""

    rows: int = 0
    lo: float | None = None
    hi: float | None = None
    counts: dict[str, dict[str, int]] = field(default_factory=dict)

    def labels(self, category: str) -> list[str]:
        """Values by falling frequency, equal ones by name."""
        counts = self.counts.get(category, {})
        return sorted(counts, key=lambda value: (-counts[value], value))

    def idf(self, size: int, min_doc_freq: int) -> list[float]:
        out = [0.0] * size
        for bucket, df in self.counts.get(TERM, {}).items():
            if df >= min_doc_freq:
                out[int(bucket)] = log((self.rows + 1.0) / (df + 1.0))
        return out


def sides_of(training: DataFrame, folds: int) -> list[Side]:
    """The training sides as the driver needs them: a row per category value and hash bucket."""
    sides = [Side() for _ in range(folds)]
    for row in training.toLocalIterator():
        side = sides[row.fold]
        if row.kind == ROWS:
            side.rows, side.lo, side.hi = row.n, row.lo, row.hi
        else:
            side.counts.setdefault(row.kind, {})[row.key] = row.n
    return sides
