"""What a plot would show, as tables: histograms, box plots, bars, scatter, correlation.

Only bins and summary rows ever leave the cluster.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement
from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stellarate.functions.numbers import known, numeric_columns
from stellarate.functions.sampling import hash_sample
from stellarate.operators.columns import drop_incomplete_rows
from stellarate.operators.ordered import ValueCounts


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, nulls left out."""
    value = F.col(f"`{column}`")
    return df.where(value.isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("count"))


def top_values(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The ``k`` most frequent values; equal counts are ordered by value."""
    return value_counts(df, column).orderBy(F.desc("count"), F.col(f"`{column}`")).limit(k)


def first_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    return df.orderBy(*[F.col(f"`{name}`") for name in order]).limit(n)


def last_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The last ``n`` rows by ``order``, latest first."""
    return df.orderBy(*[F.col(f"`{name}`").desc() for name in order]).limit(n)


def _values(df: DataFrame, column: str) -> DataFrame:
    known = drop_incomplete_rows(df, [column])
    return known.select(F.col(f"`{column}`").cast("double").alias("x"))


def _finite(df: DataFrame, column: str) -> DataFrame:
    """The finite values: an infinity has no place in bins of equal width."""
    return _values(df, column).where(F.abs("x") != F.lit(float("inf")))


def infinite_counts(df: DataFrame, column: str) -> DataFrame:
    """One row (below, above): values of minus and plus infinity, which histograms leave out."""
    inf = F.lit(float("inf"))
    return _values(df, column).agg(
        F.count_if(F.col("x") == -inf).alias("below"), F.count_if(F.col("x") == inf).alias("above")
    )


def _limits(values: DataFrame, *names: str) -> list[tuple[float, float]]:
    """(lowest, highest) of each column, half a unit further apart if they are equal."""
    ends = values.agg(*[f(n) for n in names for f in (F.min, F.max)]).first()
    pairs = [(lo or 0.0, hi or 0.0) for lo, hi in zip(ends[::2], ends[1::2])]
    return [(lo - 0.5, hi + 0.5) if lo == hi else (lo, hi) for lo, hi in pairs]


def _edge(lo: float, hi: float, bins: int, number: Column) -> Column:
    inner = F.lit(lo) + number * F.lit((hi - lo) / bins)
    return F.when(number == bins, F.lit(hi)).otherwise(inner)


def _equal_bin(x: Column, lo: float, hi: float, bins: int) -> Column:
    """Bin of ``x``; bins are closed below, the last one also above.

    The quotient may be off by one next to an edge, so it is checked against
    the edges themselves.
    """
    guess = F.least(F.floor((x - lo) / (hi - lo) * bins), F.lit(bins - 1))
    return (
        F.when(x < _edge(lo, hi, bins, guess), guess - 1)
        .when((x >= _edge(lo, hi, bins, guess + 1)) & (guess < bins - 1), guess + 1)
        .otherwise(guess)
    )


def _binned(values: DataFrame, lo: float, hi: float, bins: int) -> DataFrame:
    """Counts of the non-empty equal-width bins."""
    return (
        values.select(_equal_bin(F.col("x"), lo, hi, bins).alias("bin"))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def _bin_row(lo: float, hi: float, bins: int) -> list[Column]:
    number = F.col("bin")
    return [
        number,
        _edge(lo, hi, bins, number).alias("lower"),
        _edge(lo, hi, bins, number + 1).alias("upper"),
        F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count"),
    ]


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Equal-width histogram of the finite values: (bin, lower, upper, count), empty bins included."""
    values = _finite(df, column)
    [(lo, hi)] = _limits(values, "x")
    every_bin = df.sparkSession.range(bins, numPartitions=1).withColumnRenamed("id", "bin")
    joined = every_bin.join(_binned(values, lo, hi, bins), "bin", "left")
    return joined.select(*_bin_row(lo, hi, bins))


def histogram_of_edges(df: DataFrame, column: str, edges: Sequence[float]) -> DataFrame:
    """Histogram on given rising edges; values outside of them are not counted."""
    x, last = F.col("x"), len(edges) - 2
    at_or_above = sum(((x >= F.lit(float(edge))).cast("int") for edge in edges), F.lit(0))
    counts = (
        _values(df, column)
        .where(x.between(float(edges[0]), float(edges[-1])))
        .select(F.least(at_or_above - 1, F.lit(last)).cast("bigint").alias("bin"))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    ends = F.array(*[F.lit(float(edge)) for edge in edges])
    every_bin = df.sparkSession.range(last + 1, numPartitions=1).withColumnRenamed("id", "bin")
    number = F.col("bin").cast("int")
    return every_bin.join(counts, "bin", "left").select(
        "bin",
        F.get(ends, number).alias("lower"),
        F.get(ends, number + 1).alias("upper"),
        F.coalesce("count", F.lit(0)).cast("bigint").alias("count"),
    )


def automatic_histogram(df: DataFrame, column: str, empty_bins: bool = False) -> DataFrame:
    """Histogram whose bin width is the smaller of the Sturges and the
    Freedman-Diaconis width (Sturges alone where the quartiles coincide).

    Of the finite values. Empty bins are left out unless ``empty_bins`` is set: with
    far outliers there can be very many.
    """
    values = _finite(df, column)
    [(lo, hi)] = _limits(values, "x")
    box = ValueCounts(values, ["x"]).quantiles([0.25, 0.75]).first()
    if box is None:
        return _binned(values, lo, hi, 1).select(*_bin_row(lo, hi, 1))
    steps = [(hi - lo) / (log2(box["n"]) + 1), 2 * (box["q1"] - box["q0"]) / box["n"] ** (1 / 3)]
    bins = ceil((hi - lo) / min(step for step in steps if step > 0))
    counts = _binned(values, lo, hi, bins)
    if empty_bins:
        counts = df.sparkSession.range(bins).toDF("bin").join(counts, "bin", "left")
    return counts.select(*_bin_row(lo, hi, bins))


def _box(value: Column, low: Column, high: Column, n: Column, q1: Column, q3: Column) -> list[Column]:
    """Aggregates for whisker ends and outliers, given the fences."""
    inside = value.between(low, high)
    return [
        F.least(F.min(F.when(inside, value)), q1).alias("whisker_low"),
        F.greatest(F.max(F.when(inside, value)), q3).alias("whisker_high"),
        F.coalesce(F.sum(F.when(~inside, n)), F.lit(0)).cast("bigint").alias("outliers"),
    ]


def box_statistics(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Box-plot numbers: q1, median, q3, whisker ends, outliers, rows.

    Whiskers end at the outermost values within 1.5 interquartile ranges of the
    box, and at the box where there are none.
    """
    counted = ValueCounts(df, [column], by)
    quartiles = counted.quantiles([0.25, 0.5, 0.75])
    if by:
        return _grouped_boxes(counted, quartiles)
    box = quartiles.first()
    q1, median, q3 = (F.lit(box and box[name]).cast("double") for name in ("q0", "q1", "q2"))
    low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    return _values(df, column).agg(
        q1.alias("q1"),
        median.alias("median"),
        q3.alias("q3"),
        *_box(F.col("x"), low, high, F.lit(1), q1, q3),
        F.count(F.lit(1)).alias("rows"),
    )


def _grouped_boxes(counted: ValueCounts, quartiles: DataFrame) -> DataFrame:
    """Boxes per group. The fences go to the bucket totals first, at most one row
    per bucket and group, so a group with most of the rows is read in pieces."""
    keys = counted.keys
    iqr = F.col("q2") - F.col("q0")
    boxes = quartiles.select(
        *keys,
        "q0",
        "q1",
        "q2",
        (F.col("q0") - 1.5 * iqr).alias("low"),
        (F.col("q2") + 1.5 * iqr).alias("high"),
    )
    fenced = counted.offsets.select(*keys, "bucket", "total_n").join(boxes, keys)
    rows = counted.values.join(fenced, [*keys, "bucket"])
    q1, q3 = F.first("q0"), F.first("q2")
    return (
        rows.groupBy(*keys)
        .agg(
            q1.alias("q1"),
            F.first("q1").alias("median"),
            q3.alias("q3"),
            *_box(F.col("value"), F.col("low"), F.col("high"), F.col("n"), q1, q3),
            F.first("total_n").alias("rows"),
        )
        .drop("column")
    )


def correlation(df: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation of all pairs of numeric columns, long: (x, y, r).

    All pairs share one pass; a pair skips the rows where either value is missing.
    """
    names = list(columns) or numeric_columns(df)
    cells = []
    for x, y in combinations_with_replacement(names, 2):
        both = known(df, x).isNotNull() & known(df, y).isNotNull()
        a, b = F.when(both, known(df, x)), F.when(both, known(df, y))
        # null, and no failure, where one of them does not vary
        r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
        for left, right in dict.fromkeys([(x, y), (y, x)]):
            cells.append(F.struct(F.lit(left).alias("x"), F.lit(right).alias("y"), r.alias("r")))
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def scatter_sample(
    df: DataFrame, x: str, y: str, keys: list[str], fraction: float, seed: int
) -> DataFrame:
    """The (x, y) points of a reproducible sample of the rows."""
    return hash_sample(df, keys, fraction, seed).select(x, y)


def scatter_counts(
    df: DataFrame, x: str, y: str, x_bins: int = 50, y_bins: int = 50
) -> DataFrame:
    """All (x, y) points as counts on an equal-width grid, without empty cells."""
    points = drop_incomplete_rows(df, [x, y]).select(
        F.col(x).cast("double").alias("px"), F.col(y).cast("double").alias("py")
    )
    (x_lo, x_hi), (y_lo, y_hi) = _limits(points, "px", "py")
    return (
        points.select(
            _equal_bin(F.col("px"), x_lo, x_hi, x_bins).alias("x_bin"),
            _equal_bin(F.col("py"), y_lo, y_hi, y_bins).alias("y_bin"),
        )
        .groupBy("x_bin", "y_bin")
        .agg(F.count(F.lit(1)).alias("count"))
    )
