from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from stellarate.operators import ordered


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows in group 'hot', a third of them with the same value."""
    rng = np.random.default_rng(1)
    rows = [("hot", 7.0) for _ in range(300)]
    rows += [("hot", float(x)) for x in rng.normal(0, 50, 400)]
    rows += [(f"g{i % 9}", float(x)) for i, x in enumerate(rng.normal(10, 1, 400))]
    rows += [("one", 4.0), ("two", 1.0), ("two", 2.0)]
    return spark.createDataFrame(rows, "g string, x double")


@pytest.mark.parametrize("points", [[0.0], [-50.0, 0.0, 7.0, 9.0, 10.0, 11.0], None])
def test_quantiles_do_not_depend_on_the_cut_points(skewed, monkeypatch, points):
    if points is not None:
        monkeypatch.setattr(ordered, "cut_points", lambda df, value: points)
    shares = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    got = ordered.ValueCounts(skewed, ["x"], ["g"]).quantiles(shares).collect()
    frame = skewed.toPandas()
    assert len(got) == frame.g.nunique()
    for row in got:
        values = frame[frame.g == row.g].x
        assert row.n == len(values)
        assert np.allclose([row[f"q{i}"] for i in range(6)], np.quantile(values, shares))


@pytest.mark.parametrize("points", [[0.0], [-50.0, 0.0, 7.0, 9.0, 10.0, 11.0]])
def test_quantiles_without_groups(skewed, monkeypatch, points):
    monkeypatch.setattr(ordered, "cut_points", lambda df, value: points)
    shares = [0.0, 0.25, 0.5, 0.99, 1.0]
    frame = skewed.withColumn("y", -F.col("x"))
    got = {r["column"]: r for r in ordered.ValueCounts(frame, ["x", "y"]).quantiles(shares).collect()}
    values = skewed.toPandas().x
    for name, sign in (("x", 1), ("y", -1)):
        assert got[name].n == len(values)
        found = [got[name][f"q{i}"] for i in range(len(shares))]
        assert np.allclose(found, np.quantile(sign * values, shares))


def test_cut_points_come_from_a_sample_of_big_inputs(spark, monkeypatch):
    monkeypatch.setattr(ordered, "CUT_POINT_ROWS", 500)
    monkeypatch.setattr(ordered, "ROWS_PER_BUCKET", 2500)
    ids = spark.range(20_000).select(F.col("id").cast("double").alias("x"))
    points = ordered.cut_points(ids, "x")
    assert len(points) == 7 and points == sorted(points)
    monkeypatch.setattr(ordered, "MOST_POINTS", 3)
    assert len(ordered.cut_points(ids, "x")) >= 2


def test_running_totals(spark):
    rows = [(float(i % 50), i % 3) for i in range(1000)]
    counts = spark.createDataFrame(rows, "x double, m int").groupBy("x").agg(F.sum("m").alias("m"))
    placed = ordered.in_buckets(counts, "x", [3.0, 10.0, 11.0, 40.0])
    rows_of_buckets = placed.join(ordered.bucket_offsets(placed, [], ["m"]), "bucket")
    got = ordered.with_running_totals(rows_of_buckets, [], "x", ["m"]).collect()
    for row in got:
        assert row.upto_m == sum(m for x, m in rows if x <= row.x)
        assert row.total_m == sum(m for _, m in rows)


def test_numbered_is_the_place_in_the_order(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("v")).repartition(7)
    got = ordered.numbered(rows, F.desc("v")).collect()
    ranked = sorted((r.v for r in got), reverse=True)
    assert all(ranked[r.position] == r.v for r in got)


@pytest.mark.parametrize("most", [3, 8192])
def test_full_buckets_are_cut_again(spark, monkeypatch, most):
    """Few points per sketch, and first points that are all wrong: results stay exact."""
    monkeypatch.setattr(ordered, "ROWS_PER_BUCKET", 50)
    monkeypatch.setattr(ordered, "MOST_POINTS", most)
    rows = spark.range(2000).select((F.col("id") * F.col("id") % 1009).cast("double").alias("x"))
    points = ordered.cut_points(rows, "x")
    assert len(points) > 2
    wrong = ordered.finer_points(rows, "x", [-5.0, -4.0, 5000.0])
    sizes = [r["count"] for r in ordered.in_buckets(rows, "x", wrong).groupBy("bucket").count().collect()]
    assert max(sizes) <= 1000
    got = ordered.ValueCounts(rows, ["x"]).quantiles([0.25, 0.5]).first()
    values = np.array([r.x for r in rows.collect()])
    assert (got.q0, got.q1) == tuple(np.quantile(values, [0.25, 0.5]))
