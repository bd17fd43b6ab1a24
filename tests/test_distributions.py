from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stellarate.operators import distributions as dist

STAR_EDGES = [1, 1.5, 2, 2.5, 3, 3.5, 4, 4.5, 5]


def column(spark, values):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double")


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(-1000, 1000).map(lambda n: n / 7), min_size=1, max_size=60))
def test_histogram_is_that_of_numpy(spark, values):
    counts, edges = np.histogram(values, bins=10)
    got = dist.histogram(column(spark, values + [None]), "x").orderBy("bin").collect()
    assert [r["count"] for r in got] == counts.tolist()
    assert np.allclose([r.lower for r in got] + [got[-1].upper], edges)


def test_histogram_of_a_constant(spark):
    got = dist.histogram(column(spark, [3, 3, 3]), "x").orderBy("bin").collect()
    assert [r["count"] for r in got] == np.histogram([3, 3, 3], bins=10)[0].tolist()
    assert (got[0].lower, got[-1].upper) == (2.5, 3.5)


def test_histogram_edges_close_the_last_bin(spark):
    stars = [1, 1.5, 4.5, 5, 5, 0.5, 6, None, float("nan")]
    got = dist.histogram_of_edges(column(spark, stars), "x", STAR_EDGES).orderBy("bin").collect()
    known = [s for s in stars if s == s and s is not None]
    assert [r["count"] for r in got] == np.histogram(known, bins=STAR_EDGES)[0].tolist()


@pytest.mark.parametrize("scale", [1.0, 40.0])
def test_automatic_histogram_is_that_of_numpy(spark, scale):
    values = np.random.default_rng(3).exponential(scale, 400)
    counts, edges = np.histogram(values, bins="auto")
    got = {r.bin: r["count"] for r in dist.automatic_histogram(column(spark, values), "x").collect()}
    assert got == {i: n for i, n in enumerate(counts.tolist()) if n}
    one = dist.automatic_histogram(column(spark, [2, 2, 2]), "x").collect()
    assert sum(r["count"] for r in one) == 3


def test_box_statistics(spark):
    values = [1.0, 2.0, 2.5, 3.0, 3.5, 4.0, 50.0, -40.0]
    row = dist.box_statistics(column(spark, values + [None]), "x").first()
    q1, median, q3 = np.quantile(values, [0.25, 0.5, 0.75])
    low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    inside = [v for v in values if low <= v <= high]
    assert (row.q1, row["median"], row.q3) == (q1, median, q3)
    assert (row.whisker_low, row.whisker_high) == (min(inside), max(inside))
    assert (row.outliers, row.rows) == (2, 8)


def test_box_statistics_by_group(spark):
    rows = [("a", float(i)) for i in range(99)] + [("b", 5.0)] * 500
    frame = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: r for r in dist.box_statistics(frame, "x", ["g"]).collect()}
    assert got["a"]["median"] == 49.0 and got["a"].outliers == 0
    assert (got["b"].whisker_low, got["b"].whisker_high, got["b"].rows) == (5.0, 5.0, 500)


def test_correlation_is_that_of_pandas(spark):
    rng = np.random.default_rng(2)
    frame = pd.DataFrame(rng.normal(size=(200, 3)), columns=["a", "b", "c"])
    frame["b"] += frame["a"]
    frame.loc[::7, "c"] = np.nan
    expected = frame.corr()
    for row in dist.correlation(spark.createDataFrame(frame)).collect():
        assert abs(row.r - expected.loc[row.x, row.y]) < 1e-9


def test_value_counts_skip_null_and_break_ties_by_value(spark):
    frame = spark.createDataFrame([(c,) for c in ["b", "a", "b", "a", "c", None]], "city string")
    top = dist.top_values(frame, "city", 2).collect()
    assert [tuple(r) for r in top] == [("a", 2), ("b", 2)]


def test_first_and_last_rows(spark):
    ids = spark.range(100).repartition(5)
    assert [r.id for r in dist.first_rows(ids, ["id"], 3).collect()] == [0, 1, 2]
    assert [r.id for r in dist.last_rows(ids, ["id"], 3).collect()] == [99, 98, 97]


def test_scatter_counts_hold_every_point(spark):
    points = spark.createDataFrame([(float(i % 7), float(i % 5)) for i in range(100)], "a double, b double")
    cells = dist.scatter_counts(points, "a", "b", 7, 5).collect()
    assert sum(r["count"] for r in cells) == 100 and len(cells) == 35


def test_infinities_are_counted_apart(spark):
    inf = float("inf")
    rows = spark.createDataFrame([(float(i),) for i in range(10)] + [(inf,), (-inf,), (inf,)], "x double")
    bins = dist.histogram(rows, "x", 3).collect()
    assert sum(r["count"] for r in bins) == 10 and min(r.lower for r in bins) == 0.0
    assert sum(r["count"] for r in dist.automatic_histogram(rows, "x").collect()) == 10
    assert tuple(dist.infinite_counts(rows, "x").first()) == (1, 2)


def test_automatic_histogram_with_empty_bins(spark):
    rows = spark.createDataFrame([(float(i % 5),) for i in range(50)] + [(40.0,)], "x double")
    every = dist.automatic_histogram(rows, "x", empty_bins=True).collect()
    some = dist.automatic_histogram(rows, "x").collect()
    assert sorted(r.bin for r in every) == list(range(len(every))) and len(some) < len(every)
    assert {tuple(r) for r in some} <= {tuple(r) for r in every}
