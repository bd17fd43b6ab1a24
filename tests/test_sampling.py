from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from stellarate.functions import sampling


def position(*parts) -> float:
    digest = hashlib.md5("|".join(str(p) for p in parts).encode()).hexdigest()
    return int(digest[:8], 16) / 2**32


def test_sample_is_stable_under_repartitioning(spark):
    ids = spark.range(5000)
    kept = {r.id for r in sampling.hash_sample(ids, ["id"], 0.25, 7).collect()}
    again = {r.id for r in sampling.hash_sample(ids.repartition(13), ["id"], 0.25, 7).collect()}
    assert kept == again == {i for i in range(5000) if position(i, 7) < 0.25}


@pytest.mark.parametrize("fraction, rows", [(0.0, 0), (1.0, 100)])
def test_sample_bounds(spark, fraction, rows):
    assert sampling.hash_sample(spark.range(100), ["id"], fraction, 1).count() == rows


def test_split_is_disjoint_and_covers(spark):
    parts = sampling.hash_split(spark.range(3000), ["id"], [0.7, 0.2, 0.1], 42)
    ids = [{r.id for r in part.collect()} for part in parts]
    assert sorted(i for part in ids for i in part) == list(range(3000))
    assert abs(len(ids[0]) - 2100) < 150


def test_folds_are_even(spark):
    fold = sampling.fold_number(["id"], 3, 42)
    counts = spark.range(3000).groupBy(fold.alias("f")).count().collect()
    assert {r.f for r in counts} == {0, 1, 2}
    assert all(abs(r["count"] - 1000) < 120 for r in counts)


def test_bernoulli_sample_takes_no_row_twice(spark):
    ids = [r.id for r in sampling.bernoulli_sample(spark.range(1000), 0.5, 3).collect()]
    assert len(ids) == len(set(ids)) and 400 < len(ids) < 600


def test_null_keys_are_drawn_like_others(spark):
    rows = spark.range(2000).select(F.lit(None).cast("string").alias("key"), "id")
    kept = sampling.hash_sample(rows, ["key"], 0.4, 1).count()
    assert 700 < kept < 900
    sizes = [part.count() for part in sampling.hash_split(rows, ["key"], [0.5, 0.5], 1)]
    assert sum(sizes) == 2000 and min(sizes) > 850
    pair = spark.createDataFrame([("a", None), (None, "a")], "p string, q string")
    assert len({r[0] for r in pair.select(sampling.draw(["p", "q"], 1)).collect()}) == 2
