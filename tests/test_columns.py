from __future__ import annotations

from pyspark.sql import functions as F

from stellarate.functions.numbers import binarize
from stellarate.operators import columns as cols


def test_lift_from_null_struct(spark):
    rows = spark.createDataFrame(
        [(1, None), (2, ("loud", None)), (3, ("quiet", "casual"))],
        "id int, attributes struct<NoiseLevel: string, Ambience: string>",
    )
    lifted = cols.lift_fields(rows, {"noise": "attributes.NoiseLevel"})
    assert [r.noise for r in lifted.orderBy("id").collect()] == [None, "loud", "quiet"]


def test_drop_ignores_missing_names(spark):
    assert cols.drop_columns(spark.range(1), "nothing", "hours").columns == ["id"]


def test_incomplete_rows_like_dropna(spark):
    rows = spark.createDataFrame(
        [(1.0, "a"), (None, "b"), (float("nan"), "c"), (2.0, None)], "x double, y string"
    )
    kept = cols.drop_incomplete_rows(rows)
    assert kept.collect() == rows.dropna().collect() == [(1.0, "a")]


def test_incomplete_row_filter_reaches_the_scan(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("value", "event_type")
    plan = cols.drop_incomplete_rows(events)._jdf.queryExecution().executedPlan().toString()
    assert "IsNotNull(value)" in plan and "IsNotNull(event_type)" in plan


def test_schema_profile(spark):
    rows = cols.schema_profile(spark.range(1).withColumn("s", F.lit("a"))).collect()
    assert [tuple(r) for r in rows] == [(0, "id", "bigint", False), (1, "s", "string", False)]


def test_binarize_keeps_null(spark):
    rows = spark.createDataFrame([(2.5,), (2.999,), (3.0,), (None,)], "x double")
    got = [r[0] for r in rows.select(binarize(F.col("x"))).collect()]
    assert got == [0.0, 0.0, 1.0, None]
