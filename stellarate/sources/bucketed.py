"""Tables laid out for joins: dealt to buckets by their key and sorted, once, when written.

Two tables with the same number of buckets join bucket by bucket without moving a row. A bucket
cannot be divided when it is read, so the rows of keys that would fill a bucket by
themselves, and those without a key, are kept beside the buckets.
"""

from __future__ import annotations

from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stellarate.operators.joins import ROWS_PER_PART, hot_keys
from stellarate.sources.tables import read_parquet, write_parquet

#: Rows that a bucket should have.
BUCKET_ROWS = 2_000_000


@dataclass(frozen=True)
class Bucketed:
    """A table under ``path``: ``even`` in buckets, known to the session as ``name``, and ``hot``."""

    name: str
    path: str
    key: str
    buckets: int

    @property
    def even_path(self) -> str:
        return f"{self.path.rstrip('/')}/even"

    @property
    def hot_path(self) -> str:
        return f"{self.path.rstrip('/')}/hot"

    def even(self, spark: SparkSession) -> DataFrame:
        return spark.table(self.name)

    def hot(self, spark: SparkSession) -> DataFrame:
        return read_parquet(spark, self.hot_path)

    def rows(self, spark: SparkSession) -> DataFrame:
        return self.even(spark).unionByName(self.hot(spark))

    def forget(self, spark: SparkSession) -> None:
        """Take the name from the session; the files stay."""
        spark.sql(f"DROP TABLE IF EXISTS `{self.name}`")


def bucket_count(rows: int, bucket_rows: int = BUCKET_ROWS) -> int:
    """The power of two that gives about ``bucket_rows`` rows to a bucket.

    Powers of two, so that the buckets of a smaller table fit into those of a larger one.
    """
    return 1 << max(0, -(-rows // bucket_rows) - 1).bit_length()


def write_bucketed(
    df: DataFrame, path: str, key: str, buckets: int, rows_per_part: int = ROWS_PER_PART
) -> Bucketed:
    """Write ``df`` under ``path``, which must not exist, in buckets by ``key``.

    One file per bucket, made by one shuffle. Keys with over ``rows_per_part`` rows, and over
    a thousandth of all, go to ``hot`` with the rows whose key is null, unshuffled.
    """
    if "." in key or "`" in key:
        raise ValueError(f"a bucket column cannot be named {key}")
    spark = df.sparkSession
    table = Bucketed(f"bucketed_{uuid4().hex}", path, key, buckets)
    keys = F.broadcast(hot_keys(df, key, rows_per_part).select(key))
    crowded = df.where(F.col(key).isNotNull()).join(keys, key, "left_semi")
    write_parquet(crowded.unionByName(df.where(F.col(key).isNull())), table.hot_path)
    even = df.where(F.col(key).isNotNull()).join(keys, key, "left_anti").select(*df.columns)
    writer = even.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
    writer.option("path", table.even_path).format("parquet").saveAsTable(table.name)
    spark.catalog.refreshTable(table.name)
    return table


def open_bucketed(spark: SparkSession, path: str, key: str, buckets: int) -> Bucketed:
    """A table that an earlier session has written, made known to this one."""
    table = Bucketed(f"bucketed_{uuid4().hex}", path, key, buckets)
    columns = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in read_parquet(spark, table.even_path).schema
    )
    spark.sql(
        f"CREATE TABLE `{table.name}` ({columns}) USING parquet "
        f"CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{table.even_path}'"
    )
    return table


def bucketed_join(spark: SparkSession, fact: Bucketed, dimension: Bucketed) -> DataFrame:
    """Inner join of two tables on their common key, which is unique in ``dimension``.

    A dimension has no hot keys, as its keys are unique. The buckets are merged as they lie:
    no row of them is shuffled. Only the dimension's rows
    for the fact table's hot keys, at most a thousand, are broadcast to its hot rows.
    """
    if fact.key != dimension.key:
        raise ValueError(f"keys differ: {fact.key}, {dimension.key}")
    key = fact.key
    even = fact.even(spark).hint("merge").join(dimension.even(spark), key)
    hot = fact.hot(spark).where(F.col(key).isNotNull())
    if not hot.limit(1).count():
        return even
    wanted = F.broadcast(hot.select(key).distinct())
    few = dimension.rows(spark).join(wanted, key, "left_semi")
    return even.unionByName(hot.join(F.broadcast(few), key).select(*even.columns))
