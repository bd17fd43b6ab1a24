from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from stellarate.operators.encoding import category_index, index_categories, min_max
from stellarate.operators import joins
from stellarate.operators.joins import join_dimension


@pytest.fixture(scope="module")
def facts(spark):
    """A third of the rows have key 0; key 999 has no dimension row."""
    key = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") == 1, 999).otherwise(F.col("id") % 700)
    return spark.range(6000).select("id", key.cast("bigint").alias("key"))


@pytest.mark.parametrize("limit", [0, 1 << 30])
def test_join_is_the_plain_join(spark, facts, limit):
    dimension = spark.range(900).select(F.col("id").alias("key"), (F.col("id") * 2).alias("twice"))
    joined = join_dimension(facts, dimension, "key", ["id"], limit)
    assert joined.columns == ["key", "id", "twice"]
    expected = facts.join(dimension, "key")
    assert sorted(joined.collect()) == sorted(expected.collect())


def test_hot_key_is_dealt_to_parts_by_its_rows(spark, facts):
    """A third of 6,000 rows, 300 rows a part: seven parts, none far above 300 rows."""
    hot = joins.hot_keys(facts, "key", rows_per_part=300)
    assert [tuple(r) for r in hot.collect()] == [(0, 7)]
    parts = joins.dealt(facts, hot, "key", ["id"]).where("key = 0").groupBy("_salt").count().collect()
    assert len(parts) == 7 and max(r["count"] for r in parts) < 400
    dimension = spark.range(900).select(F.col("id").alias("key"), (F.col("id") * 2).alias("twice"))
    assert joins.repeated(dimension, hot, "key").where("key = 0").count() == 7
    joined = join_dimension(facts, dimension, "key", ["id"], 0, rows_per_part=300)
    assert sorted(joined.collect()) == sorted(facts.join(dimension, "key").collect())


def test_null_spread_and_map_columns(spark, facts):
    odd = facts.select("key", F.create_map("id", "id").alias("m"), F.lit(None).cast("int").alias("none"))
    dimension = spark.range(900).select(F.col("id").alias("key"))
    joined = join_dimension(odd, dimension, "key", None, 0, rows_per_part=300)
    assert joined.count() == facts.join(dimension, "key").count()


def test_join_of_empty_sides(spark, facts):
    dimension = spark.range(900).select(F.col("id").alias("key"))
    assert join_dimension(facts.where("id < 0"), dimension, "key", ["id"], 0).count() == 0
    assert join_dimension(facts, dimension.where("key < 0"), "key", ["id"], 0).count() == 0


def test_category_index_orders_by_frequency_then_value(spark):
    rows = spark.createDataFrame([(c,) for c in "b b a a c d d d".split()] + [(None,)], "c string")
    got = {r.c: r.i for r in category_index(rows, "c", "i").collect()}
    assert got == {"d": 0.0, "a": 1.0, "b": 2.0, "c": 3.0}
    assert index_categories(rows, "c", "i").count() == 8
    assert index_categories(rows, "c", "i", handle_null="keep").where("c IS NULL").first().i == 4.0
    with pytest.raises(ValueError):
        index_categories(rows, "c", "i", handle_null="error")


def test_min_max(spark):
    rows = spark.createDataFrame([(1.0, 5), (3.0, 5), (2.0, 5), (None, None)], "x double, n int")
    scaled = min_max(min_max(rows, "x", "xs"), "n", "ns").collect()
    assert [r.xs for r in scaled] == [0.0, 1.0, 0.5, None]
    assert [r.ns for r in scaled] == [0.5, 0.5, 0.5, None]
