"""Exact results that need a global order, without ordering everything in one task.

Quantiles, ROC curves and box plots all need ranks or running totals over a
whole column. Here the values are dealt to buckets by cut points, the totals per
bucket give every bucket its offset, and only within the buckets that matter are
values put in order. There they are combined to one row per distinct value first,
so a value held by a third of all rows becomes one row.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stellarate.functions.numbers import known
from stellarate.operators.columns import drop_incomplete_rows
from stellarate.session import checkpointed

ROWS_PER_BUCKET = 1_000_000
MOST_POINTS = 8192
CUT_POINT_ROWS = 2_000_000


def cut_points(df: DataFrame, value: str) -> list[float]:
    """Values that share the rows of ``df`` out evenly, ``ROWS_PER_BUCKET`` to a bucket.

    They decide how well the buckets balance and nothing else: any cut points
    give the same result. So on big inputs they come from a sample, which keeps
    the sketch that one task has to merge small.

    One sketch gives at most ``MOST_POINTS`` points. Where that leaves buckets with
    several times too many rows, each of those is cut again by a sketch of its own.
    """
    rows = df.count()
    wanted = ceil(rows / ROWS_PER_BUCKET)
    if wanted <= 1:
        return [0.0]
    buckets = min(MOST_POINTS, wanted)
    part = df.select(F.col(f"`{value}`").alias("_v"))
    if rows > CUT_POINT_ROWS:
        part = part.sample(CUT_POINT_ROWS / rows, seed=1)
    shares = [number / buckets for number in range(1, buckets)]
    points = part.agg(F.percentile_approx("_v", shares, 10 * buckets)).first()[0]
    points = sorted(set(points or [0.0]))
    return finer_points(df, value, points) if wanted > buckets else points


def finer_points(df: DataFrame, value: str, points: Sequence[float]) -> list[float]:
    """``points`` and further ones inside the buckets that have too many rows.

    A bucket that holds a single value cannot be cut and does not need to be: its
    rows become one.
    """
    dealt = in_buckets(df.select(F.col(f"`{value}`").alias("_v")), "_v", points)
    sizes = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("_v"), F.max("_v"))
    full = sizes.where((F.col("n") > 2 * ROWS_PER_BUCKET) & (F.col("min(_v)") < F.col("max(_v)")))
    most = full.agg(F.max("n")).first()[0]
    if most is None:
        return list(points)
    # the same number of points for all of them, so that one aggregate finds all
    number = min(MOST_POINTS, ceil(most / ROWS_PER_BUCKET))
    shares = [i / number for i in range(1, number)]
    inside = (
        dealt.join(F.broadcast(full.select("bucket")), "bucket", "left_semi")
        .groupBy("bucket")
        .agg(F.percentile_approx("_v", shares, 10 * number).alias("found"))
        .select(F.explode("found").alias("point"))
        .distinct()
    )
    return sorted({*points, *[row.point for row in inside.collect()]})


def in_buckets(df: DataFrame, value: str, points: Sequence[float]) -> DataFrame:
    """Add ``bucket``, increasing with ``value`` (a double without NaN or null).

    The column cannot be null, so a join on it adds no null filter to just one
    of several uses of the frame, and Spark reuses the shuffle below them.
    """
    edges = [float("-inf"), *points, float("inf")]
    bucketed = Bucketizer(splits=edges, inputCol=value, outputCol="bucket").transform(df)
    return bucketed.withColumn("bucket", F.coalesce(F.col("bucket").cast("int"), F.lit(0)))


def bucket_offsets(
    bucketed: DataFrame, keys: Sequence[str], measures: Sequence[str]
) -> DataFrame:
    """Per key and bucket and measure: ``in_``, ``before_`` and ``total_`` sums.

    The windows run over one row per bucket: one for ``ROWS_PER_BUCKET`` rows a key.
    """
    sums = bucketed.groupBy(*keys, "bucket").agg(
        *[F.sum(m).alias(f"in_{m}") for m in measures]
    )
    of_key = Window.partitionBy(*keys)
    running = of_key.orderBy("bucket")
    return sums.select(
        "*",
        *[(F.sum(f"in_{m}").over(running) - F.col(f"in_{m}")).alias(f"before_{m}") for m in measures],
        *[F.sum(f"in_{m}").over(of_key).alias(f"total_{m}") for m in measures],
    )


def with_running_totals(
    rows: DataFrame, keys: Sequence[str], value: str, measures: Sequence[str]
) -> DataFrame:
    """Add ``upto_<measure>``: the sum over all rows of the key up to this value.

    ``rows`` has one row per key and value, with the offsets of its bucket.
    """
    within = Window.partitionBy(*keys, "bucket").orderBy(value)
    return rows.withColumns(
        {f"upto_{m}": F.col(f"before_{m}") + F.sum(m).over(within) for m in measures}
    )


def stacked(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows (by..., column, value) for all known values of numeric columns."""
    if len(columns) == 1:
        # With a plain filter on the one column, the scan can skip its nulls.
        return drop_incomplete_rows(df, list(columns)).select(
            *by, F.lit(columns[0]).alias("column"), F.col(f"`{columns[0]}`").cast("double").alias("value")
        )
    doubles = df.select(*[F.col(f"`{name}`") for name in by], *[known(df, name).alias(name) for name in columns])
    keys, values = ([F.col(f"`{name}`") for name in names] for names in (by, columns))
    long = doubles.unpivot(keys, values, "column", "value")
    return long.where(F.col("value").isNotNull())


class ValueCounts:
    """The values of some columns, dealt to buckets and counted per bucket.

    The keys are the ``by`` columns and ``column``, the name of the counted one.
    Without ``by`` the rows themselves are counted per bucket, which shuffles
    next to nothing. Groups can be many, so with ``by`` the rows are combined to
    one per group and value first.
    """

    def __init__(self, df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()):
        long = stacked(df, columns, by)
        self.by = list(by)
        self.keys = [*by, "column"]
        if by:
            counts = long.groupBy(*self.keys, "value").agg(F.count(F.lit(1)).alias("n"))
        else:
            counts = long.withColumn("n", F.lit(1).cast("bigint"))
        self.values = in_buckets(counts, "value", cut_points(long, "value"))
        self.offsets = bucket_offsets(self.values, self.keys, ["n"])

    @classmethod
    def counted(cls, counts: DataFrame) -> ValueCounts:
        """The same over rows (column, value, n), which may repeat a value."""
        made = cls.__new__(cls)
        made.by, made.keys = [], ["column"]
        counts = counts.select("column", F.col("value") + 0.0, "n").toDF("column", "value", "n")
        made.values = in_buckets(counts, "value", cut_points(counts, "value"))
        made.offsets = bucket_offsets(made.values, made.keys, ["n"])
        return made

    def quantiles(self, shares: Sequence[float]) -> DataFrame:
        """Exact quantiles, linear between neighbours: keys, n, q0, q1, ...

        Only the values in buckets that hold a wanted rank are combined and put
        in order. Without ``by`` these buckets are broadcast: there are at most
        two for each column and share.
        """
        last = F.col("total_n") - 1

        def place(share: float) -> Column:
            return last * F.lit(float(share))

        ranks = [
            (F.floor(place(share)), F.ceil(place(share))) for share in shares
        ]
        start, end = F.col("before_n"), F.col("before_n") + F.col("in_n")
        wanted = F.lit(False)
        for pair in ranks:
            for rank in pair:
                wanted = wanted | ((rank >= start) & (rank < end))
        buckets = self.offsets.where(wanted)
        if not self.by:
            buckets = F.broadcast(buckets)
        held = (
            self.values.join(buckets, [*self.keys, "bucket"])
            .groupBy(*self.keys, "bucket", "value")
            .agg(
                F.sum("n").alias("n"),
                F.first("before_n").alias("before_n"),
                F.first("total_n").alias("total_n"),
            )
        )
        rows = with_running_totals(held, self.keys, "value", ["n"])

        def value_at(rank: Column) -> Column:
            covers = (rank < F.col("upto_n")) & (rank >= F.col("upto_n") - F.col("n"))
            return F.max(F.when(covers, F.col("value")))

        found = rows.groupBy(*self.keys).agg(
            F.max("total_n").alias("total_n"),
            *[value_at(low).alias(f"low{i}") for i, (low, _) in enumerate(ranks)],
            *[value_at(high).alias(f"high{i}") for i, (_, high) in enumerate(ranks)],
        )
        return found.select(
            *self.keys,
            F.col("total_n").alias("n"),
            *[
                (
                    F.col(f"low{i}")
                    + (F.col(f"high{i}") - F.col(f"low{i}"))
                    * (place(share) - F.floor(place(share)))
                ).alias(f"q{i}")
                for i, share in enumerate(shares)
            ],
        )


def numbered(df: DataFrame, *order: Column, name: str = "position") -> DataFrame:
    """Add each row's 0-based place in a total order over the whole frame.

    A distributed sort, row numbers within its partitions, and the sizes of the
    partitions before; the sorted rows are checkpointed, because numbers and
    sizes must come from the very same partitions. What is broadcast has one
    row per partition.
    """
    placed = checkpointed(
        df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id())
    )
    # A monotonic id holds the partition above bit 33 and the row below it.
    placed = placed.select(
        *df.columns,
        F.shiftrightunsigned("_id", 33).alias("_part"),
        F.col("_id").bitwiseAND((1 << 33) - 1).alias("_row"),
    )
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.select(
        "_part",
        (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"),
    )
    return placed.join(F.broadcast(before), "_part").select(
        *df.columns, (F.col("_row") + F.col("_before")).alias(name)
    )
